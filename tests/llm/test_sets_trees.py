"""Merkle manifest, shingle-set join and conversation trie against plain versions, with every odd case."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(hashes, fanout):
    """The root of some nodes, and for each of them its siblings (left, right) from the bottom up."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, p in enumerate(paths):
            run = at[i] - at[i] % fanout
            p.append(("".join(hashes[run : at[i]]), "".join(hashes[at[i] + 1 : run + fanout])))
        at = [a // fanout for a in at]
        hashes = [sha(*hashes[k : k + fanout]) for k in range(0, len(hashes), fanout)]
    return hashes[0], paths


def plain_manifest(rows, fanout):
    of = lambda r, more=0: sha(*map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    trees = {}
    for r in rows:
        trees.setdefault("" if r[2] is None else "=" + r[2], []).append((r[0] is not None, r[0] or 0, of(r), r))
    roots, found = [], []
    for name in sorted(trees, key=lambda t: t.encode()):
        leaves = sorted(trees[name], key=lambda x: x[:3])
        root, paths = climb([x[2] for x in leaves], fanout)
        roots.append(root)
        found.append((leaves, root, paths))
    top, ups = climb(roots, fanout)
    out = []
    for (leaves, subroot, paths), up in zip(found, ups):
        for (_, _, h, r), path in zip(leaves, paths):
            folded = of(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else h
            for left, right in [*path, *up]:
                folded = sha(left, folded, right)
            out.append((r[0], h, subroot, top, sha(*[a + b for a, b in [*path, *up]]), folded, folded == top))
    return out


@pytest.mark.parametrize(("fanout", "levels"), [(2, 4), (2, 1), (3, 2)])
def test_manifest(spark, fanout, levels):
    from leafmill.llm.merkle import ManifestParams, manifest, proof_digest

    rng = random.Random(fanout)
    langs = ["en"] * 70 + ["de"] * 17 + ["é"] * 2 + ["", None, "x"] + ["lone"]
    rows = [(i, rng.choice(["", None, "Text ü\n", "a" * 5000]), lang, rng.choice([None, "s", "1:a"]), rng.choice([None, 0, 7])) for i, lang in enumerate(langs)]
    rows = [*rows, rows[3], rows[3], (None, None, None, None, None), (None, "x", "en", None, 1), (3, "other text", "en", "s", 2)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA + ", tree string, path string").repartition(3)
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = manifest(df, ManifestParams(fanout=fanout, levels_each=levels), {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    got = got.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), "folded_root", "verified").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_manifest(rows, fanout)))
    if levels == 4:
        assert manifest(df.limit(0)).count() == 0
        one = manifest(df.filter("lang = 'lone'")).first()
        assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == [] and one["verified"]


def plain_join(rows, words_each=5, percent=80):
    sets = []
    for r in rows:
        w = brute.lower(r[1] or "").split() if r[1] and r[1].isascii() else []
        sets.append(frozenset(" ".join(w[k : k + words_each]) for k in range(max(1, len(w) - words_each + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return [(r[0], len(s), ids.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def near_copies(rng, words, most):
    words = list(words)
    for _ in range(rng.randint(0, most)):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_jaccard_join(spark):
    from leafmill.llm.setjoin import JoinParams, jaccard_join

    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 150))] for _ in range(12)]
    hot = [rng.choice(vocabulary) for _ in range(100)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [near_copies(rng, b, 4) for b in base for _ in range(4)] + [near_copies(rng, hot, 6) for _ in range(40)]
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(20)]
    # Distances of exactly a fifth, on both sides of it.
    line = [f"k{i}" for i in range(104)]
    texts += [" ".join(line), " ".join(line[:84]), " ".join(line[:83]), "one two", "One TWO", "one", None, "", " \n\t", "a b c d e", "a b c d e f", "x " * 3000, "x " * 9000]
    rows = [(i * 3 + 5, t) for i, t in enumerate(texts)]
    rows = [*rows, rows[0], (1, texts[5]), (None, texts[9]), (None, "alone without a number"), (None, None), (7, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, n_shingles string, _place string").repartition(3)
    want = sorted(map(repr, plain_join(rows)))
    for p in (JoinParams(), JoinParams(dense=16, pivots=10, block=7), JoinParams(dense=30, dense_shingles=2500, pivot_shingles=900)):
        got = jaccard_join(df, p)
        assert got.columns == ["doc_id", "text", "_place", "n_shingles", "component_id"]
        assert sorted(repr(tuple(r)) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == want
    assert jaccard_join(df.limit(0)).count() == 0


def test_jaccard_join_other_threshold(spark):
    from leafmill.llm.setjoin import JoinParams, jaccard_join

    rng = random.Random(9)
    base = [[f"w{rng.randrange(200)}" for _ in range(30)] for _ in range(5)]
    rows = [(i, near_copies(rng, rng.choice(base), 6)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join(df, JoinParams(words_each=2, percent=60, dense=15, pivots=8)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(plain_join(rows, 2, 60))


def plain_trie(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    made = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(said.get(c - c % 5, [])[:h] + said[c][h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for seq, cs in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        children = lambda s: sum(len(o) == len(s) + 1 and o[: len(s)] == s for o in members)
        saved = sum((len(members[s]) - 1) * len(s[-1][1].encode()) for s in below if s)
        ends = ",".join(map(str, sorted(c for c in cs if made[c] == seq)))
        out.append((min(cs), len(seq), min(members[seq[:-1]]) if seq else None, len(cs), children(seq), sum(children(s) == 0 for s in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [8, 3, 1])
def test_trie(spark, block):
    from leafmill.llm.common import Scratch
    from leafmill.llm.prefixtrie import TrieParams, numbered_turns, prefix_trie, rebased

    rng = random.Random(block)
    rows = []
    for c in range(60):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "Grüße", "", "a longer text"])) for t in range(rng.randint(1, 12))]
    for c in (100, 101, 105, 110):  # copies of one long conversation, one of them going on
        rows += [(c, t, "user", f"turn {t}") for t in range(30 + (c == 110))]
    rows += [(3, None, None, None), (3, None, "user", "first"), (3, 0, "user", None), (4, 1, "user", "tie"), (4, 1, "user", "tie"), (None, 1, "user", "nobody's"), (200, None, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(3)

    def run(df):
        tmp, conv = Scratch(spark), F.col("conv")
        convs, turns = rebased(numbered_turns(df, tmp), conv - conv % 5, F.crc32(conv.cast("string")) % 9)
        return sorted(repr(tuple(r)) for r in prefix_trie(convs, turns, TrieParams(block_turns=block, run_bits=2), tmp).collect())

    assert run(df) == sorted(map(repr, plain_trie(rows)))
    if block == 8:
        assert run(df.limit(0)) == []
