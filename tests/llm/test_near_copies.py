"""Components, and near copies by shared shingles, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute


def links_of(name, n=500):
    order = list(range(n))
    if name == "descending":
        order.reverse()
    if name == "random":
        random.Random(4).shuffle(order)
    if name == "stars":
        return [(0, i) for i in range(1, n)] + [(2 * n, n + i) for i in range(n)] + [(7, 7)]
    return [] if name == "none" else list(zip(order, order[1:]))


@pytest.mark.parametrize("name", ["ascending", "descending", "random", "stars", "none"])
def test_components(spark, name, monkeypatch):
    from leafmill.llm import neardup

    cuts, cut = [], neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df: cuts.append(1) or cut(df))
    links = links_of(name)
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    assert got == {x: root(x) for x in parent}
    assert len(cuts) <= 3 * 20 + 1  # three a round


def text(rng, n):
    return " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))


def changed(rng, words, share):
    return " ".join(w if rng.random() > share else f"x{rng.randint(0, 9)}" for w in words.split())


def test_keep_one_similar(spark):
    from leafmill.llm.shingles import ShingleParams, keep_one_similar

    rng = random.Random(6)
    first, second = text(rng, 300), text(rng, 400)
    texts = [first, *[changed(rng, first, 0.01) for _ in range(40)], second, *[changed(rng, second, 0.008) for _ in range(30)], *[text(rng, rng.randint(1, 200)) for _ in range(60)]]
    texts += [first.upper().replace(" ", "\n"), first + " " + text(rng, 200), None, "", " \n ", "one two", "ONE  two", "one two three", " ".join(["again"] * 5000), " ".join(["again"] * 6000)]
    rows = [(1000 - i if i % 9 else None, t, f"s{i % 3}", i) for i, t in enumerate(texts)] + [(5, texts[3], None, None)] * 2
    sets = [brute.shingle_set(r[1]) for r in rows]
    groups = brute.joined(len(rows), lambda i, j: brute.jaccard(sets[i], sets[j]) >= 0.8)
    docs = spark.createDataFrame(rows, "doc_id int, text string, name string, node int").repartition(3).cache()
    for p in (ShingleParams(), ShingleParams(dense=4, leaders=2)):
        got = [tuple(r) for r in keep_one_similar(docs, p).collect()]
        kept = [groups[rows.index(r)] for r in got]
        assert set(kept) == set(groups), "a group lost all its rows"
        assert len(kept) - len(set(kept)) <= 2, "near copies stay"  # the keys find nearly all
        ids = {}
        for r, g in zip(rows, groups):
            ids.setdefault(g, []).append((r[0] is None, r[0] or 0))
        assert sum((r[0] is None, r[0] or 0) == min(ids[g]) for r, g in zip(got, kept)) >= len(set(groups))
    assert keep_one_similar(docs.limit(0)).count() == 0 and keep_one_similar(docs).columns == docs.columns


def test_no_similar_pair_is_left_out(spark):
    from leafmill.llm.shingles import keep_one_similar

    rng, texts = random.Random(11), []
    for _ in range(150):
        words = text(rng, 204).split()
        texts.append(" ".join(words))
        # 200 shingles, of which 22 change: 178 / 222, or 0.802.
        copy = list(words)
        for at in (20, 70, 120, 170, 202):
            copy[at] = "changed"
        texts.append(" ".join(copy))
    sets = [brute.shingle_set(t) for t in texts]
    assert all(0.8 <= brute.jaccard(a, b) < 0.82 for a, b in zip(sets[::2], sets[1::2]))
    rng.shuffle(texts)
    sets = [brute.shingle_set(t) for t in texts]
    groups = brute.joined(len(texts), lambda i, j: brute.jaccard(sets[i], sets[j]) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3).cache()
    assert sorted(r["doc_id"] for r in keep_one_similar(docs).collect()) == sorted(set(groups))


def test_forests_span_what_lies_within_the_radius():
    import numpy as np

    from leafmill.llm.shingles import ShingleParams, _forests

    rng, p = np.random.default_rng(3), ShingleParams(radius=8)
    sizes = np.array([1, 2, 30, 0, 90, 2, 5])
    n = int(sizes.sum())
    centre = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    h1 = centre[rng.integers(0, 5, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    h2, size = np.zeros(n, np.uint64), rng.integers(90, 110, n)
    group = np.repeat(np.arange(len(sizes)), sizes)
    i, j, d = _forests(sizes, h1, h2, size, np.arange(n), p)
    near = lambda a, b: group[a] == group[b] and bin(int(h1[a] ^ h1[b])).count("1") <= p.radius and min(size[a], size[b]) >= 0.8 * max(size[a], size[b])
    assert all(near(a, b) for a, b in zip(i, j)) and len(i) == n - len(set(brute.joined(n, near)))
    linked = {(int(a), int(b)) for a, b in zip(i, j)}
    assert brute.joined(n, lambda a, b: (a, b) in linked or (b, a) in linked) == brute.joined(n, near)
    # Members of one root count as joined.
    root = rng.integers(0, 12, n)
    i, j, d = _forests(sizes, h1, h2, size, root, p)
    same = lambda a, b: group[a] == group[b] and root[a] == root[b]
    assert all(near(a, b) and not same(a, b) for a, b in zip(i, j)) and len(i) == len(set(brute.joined(n, same))) - len(set(brute.joined(n, lambda a, b: same(a, b) or near(a, b))))


def test_soft_decoding():
    import numpy as np

    from leafmill.llm.neardup import codewords, decode
    from leafmill.llm.shingles import nearest_codewords

    words, rng = codewords(), np.random.default_rng(5)
    assert (decode(words) == np.arange(4096)).all() and len(set(words.tolist())) == 4096
    sums = rng.standard_normal((40, 23))
    signs = ((words[:, None] >> np.arange(23)) & 1) * 2.0 - 1
    for row, got in zip(sums, nearest_codewords(sums, 3)):
        assert got.tolist() == np.argsort(-(signs @ row))[:3].tolist()


def test_texts_that_stay_do_not_travel(spark, monkeypatch):
    """Beyond the size that Spark broadcasts, the join that ends near-dedup dealt all texts anew."""
    import numpy as np

    from leafmill.llm import shingles
    from leafmill.llm.setjoin import SKETCH

    rng = random.Random(12)
    texts = [text(rng, 60) for _ in range(40)]
    texts += texts[:10] + [texts[11] + " more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3).cache()
    for full in (False, True):
        if full:
            # A filter that is full passes all: the join decides.
            monkeypatch.setattr(shingles, "node_filter", lambda nodes: np.full(SKETCH, 0xFFFFFFFF, np.uint32))
        out = shingles.keep_one_similar(docs)
        stay, rest = (p.toString() for p in (out._jdf.queryExecution().optimizedPlan().children().apply(i) for i in (0, 1)))
        assert "Join" not in stay and "Join LeftAnti" in rest
        assert sorted(r["doc_id"] for r in out.collect()) == list(range(40))
