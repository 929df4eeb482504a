"""Near-duplicates by shared word shingles: Golay-code keys of a wide SimHash, completed by an exact join of the sets.

Two texts are similar if their sets of ``words_each``-word shingles have a Jaccard similarity of ``percent``
hundredths or more.  The 128-bit SimHash of such a set differs in about a seventh of its bits between two
texts at 0.8.  The sums behind the bits are cut into five segments of 23, and each is decoded softly, a sum
counting by its size, to the indices of its ``codes`` nearest Golay codewords.  Texts meet under keys of 36 bits,
of three segments each: near copies mostly do, unlike texts hardly ever.

Links of a key are a minimum spanning forest of its members by fingerprint distance, up to ``radius``: a pair
that it leaves out is joined by a chain of links that are no longer.  The nearest few links of each text are
verified on the shingle sets.  So large groups of near copies are known before sets are compared.

No key finds all similar pairs, so the rest comes from the exact join of sets (``setjoin``): texts share rare
shingles, and those of different groups so far are compared.  Every pair that is similar ends in one group.

Scale: equal sets collapse first, and only texts that share enough rare shingles with others have keys.  Keys
whose members are of one group already go by their count.  The members of a key with more
than ``dense`` are compared with some of them, the leaders, spread over the cluster by a join; those near a
leader link to it, the rest goes into the next round with more leaders, until no more than ``dense`` are left,
which are linked as above.

Defined results: null and empty texts are equal to one another; a text below ``words_each`` words is one
shingle; repeated rows are equal texts; a group's kept row is that of its smallest id (null ids last), then
of the first place in the scan; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Scratch, bounded_batches, hidden, with_place
from leafmill.llm.neardup import codewords
from leafmill.llm.setjoin import _MIX, JoinParams, _linked, _mixed, _passes, _sets, node_filter, shingle_sketch, signature, similar_sets

SEGMENTS = 5
TRIPLES = tuple(combinations(range(SEGMENTS), 3))
MAX_TASKS = 20_000
MEMBER = ("node", "h1", "h2", "n", "root")


@dataclass(frozen=True)
class ShingleParams:
    words_each: int = 5
    #: Hundredths: texts are similar when 100 * intersection >= percent * union.
    percent: int = 80
    #: Bits of 128; three standard deviations beyond the mean at a similarity of 0.8.
    radius: int = 31
    dense: int = 4096
    #: Leaders of a dense key in the first round; four times as many in each further one.
    leaders: int = 64
    #: Codewords of a segment: each key of three segments is made of one of each.
    codes: int = 3
    #: Numbers of the triples of segments that make keys.
    triples: tuple[int, ...] = (0,)
    #: Links of a text that are verified, the nearest first.
    nearest: int = 4
    #: Texts whose keys one task makes.
    texts_each: int = 5_000
    seed: int = 42

    def join(self) -> JoinParams:
        return JoinParams(words_each=self.words_each, percent=self.percent, seed=self.seed)


@lru_cache(1)
def _signs() -> np.ndarray:
    """Codewords as columns of -1 and 1."""
    return (((codewords()[None, :] >> np.arange(23)[:, None]) & 1) * 2.0 - 1).astype(np.float32)


def nearest_codewords(sums: np.ndarray, codes: int) -> np.ndarray:
    """Indices of the codewords nearest to each row of 23 real numbers, nearest first."""
    out = np.zeros((len(sums), codes), np.int16)
    for at in range(0, len(sums), 256):
        near = sums[at : at + 256].astype(np.float32) @ _signs()
        rows = np.arange(len(near))
        for k in range(codes):
            best = near.argmax(axis=1)
            out[at : at + 256, k] = best
            near[rows, best] = -np.inf
    return out


def simhash_sums(names: np.ndarray) -> np.ndarray:
    """The 128 sums of a set of shingles, told by their 64-bit names."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(names), 1 << 15):
        some = names[at : at + (1 << 15)]
        ones += np.unpackbits(np.stack([some, _mixed(some + _MIX)], axis=1).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return 2 * ones - len(names)


def described(text: Column, order, params: ShingleParams) -> Column:
    """Struct of n (shingles), name and keys (the signature) of the set of a text, h1, h2 and codes (of the segments)."""
    of = params.join()

    @F.pandas_udf("struct<n:long,name:binary,keys:array<long>,h1:long,h2:long,codes:binary>")
    def of_texts(texts: pd.Series) -> pd.DataFrame:
        out, sums = [], np.zeros((len(texts), 128), np.int64)
        for i, s in enumerate(_sets(texts, of)):
            out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s, order.value, of.percent).view(np.int64)))
            sums[i] = simhash_sums(s)
        h = np.packbits(sums > 0, axis=1).view("<i8").reshape(-1, 2)
        codes = nearest_codewords(sums[:, : 23 * SEGMENTS].reshape(-1, 23), params.codes).reshape(len(sums), SEGMENTS * params.codes)
        return pd.DataFrame(out, columns=["n", "name", "keys"]).assign(h1=h[:, 0], h2=h[:, 1], codes=[c.tobytes() for c in codes])

    return of_texts(text)


def triple_keys(codes: np.ndarray, triple: int) -> np.ndarray:
    """Keys of three segments from ``codes`` (row, segment, codeword): all combinations of their codewords."""
    a, b, c = (codes[:, i, :].astype(np.int64) for i in TRIPLES[triple])
    return (np.int64(triple) << 36 | a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :]).reshape(len(codes), -1)


def _distance(a: tuple, b: tuple, params: ShingleParams) -> np.ndarray:
    """Fingerprint distance; beyond the radius where the sizes rule the similarity out."""
    d = np.bitwise_count(a[0] ^ b[0]).astype(np.int16) + np.bitwise_count(a[1] ^ b[1])
    return np.where(100 * np.minimum(a[2], b[2]) >= params.percent * np.maximum(a[2], b[2]), d, 999)


def _spanning(h1: np.ndarray, h2: np.ndarray, n: np.ndarray, root: np.ndarray, params: ShingleParams) -> list[tuple[int, int, int]]:
    """(i, j, distance): a minimum spanning forest of the members, by Prim's method on whole rows.  Members of one root are joined as it is."""
    m, out = len(h1), []
    best, parent, left = np.full(m, 999, np.int16), np.zeros(m, np.int64), np.ones(m, bool)
    at = 0
    for _ in range(m):
        left[at] = False
        d = np.where(root == root[at], -1, _distance((h1[at], h2[at], n[at]), (h1, h2, n), params))
        nearer = left & (d < best)
        best[nearer], parent[nearer] = d[nearer], at
        waiting = np.where(left, best, 1000)
        at = int(np.argmin(waiting))
        if 0 <= waiting[at] <= params.radius:
            out.append((int(parent[at]), at, int(waiting[at])))
    return out


def _forests(sizes: np.ndarray, h1: np.ndarray, h2: np.ndarray, n: np.ndarray, root: np.ndarray, params: ShingleParams, small: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (i, j, distance) inside each of the consecutive groups of the given sizes, between members of different roots."""
    start = np.cumsum(sizes) - sizes
    member = np.repeat(np.where(sizes <= small, sizes, 0), sizes)
    after = np.maximum(0, member - 1 - (np.arange(len(h1)) - np.repeat(start, sizes)))
    i = np.repeat(np.arange(len(h1)), after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    d = _distance((h1[i], h2[i], n[i]), (h1[j], h2[j], n[j]), params)
    near = (d <= params.radius) & (root[i] != root[j])
    i, j, d = i[near], j[near], d[near]
    group = np.repeat(np.arange(len(sizes)), sizes)[i]
    out, above = [], {}

    def find(x: tuple) -> tuple:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for k in np.argsort(d, kind="stable").tolist():
        a, b = find((group[k], root[i[k]])), find((group[k], root[j[k]]))
        if a != b:
            above[a] = b
            out.append((int(i[k]), int(j[k]), int(d[k])))
    for g in np.flatnonzero(sizes > small).tolist():
        part = slice(start[g], start[g] + sizes[g])
        out += [(int(start[g]) + a, int(start[g]) + b, c) for a, b, c in _spanning(h1[part], h2[part], n[part], root[part], params)]
    cols = np.array(out, np.int64).reshape(-1, 3)
    return cols[:, 0], cols[:, 1], cols[:, 2]


def _forest_links(groups: DataFrame, params: ShingleParams) -> DataFrame:
    """Links (u, v, d) inside each array ``members`` of structs."""

    def link(batches):
        for batch in batches:
            column = batch.column(0)
            sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()
            node, h1, h2, n, root = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
            i, j, d = _forests(sizes, h1.view(np.uint64), h2.view(np.uint64), n, root, params)
            yield pa.RecordBatch.from_pydict({"u": np.minimum(node[i], node[j]), "v": np.maximum(node[i], node[j]), "d": d.astype(np.int32)})

    return groups.select("members").mapInArrow(link, "u long, v long, d int")


def _near_leaders(crowded: DataFrame, leaders: int, params: ShingleParams) -> DataFrame:
    """``crowded`` with ``leader`` (node and distance of the nearest one within the radius) and whether the row itself ``leads``."""
    rank = F.xxhash64(F.lit(leaders), F.col("node"))
    slot = F.pmod(F.xxhash64(F.lit(-leaders), F.col("node")), F.lit(leaders))
    first = crowded.groupBy("key", slot.alias("slot")).agg(F.min(F.struct(rank.alias("rank"), *MEMBER)).alias("l"))
    ahead = first.groupBy("key").agg(F.collect_list("l").alias("ahead"))
    d = lambda x: (F.bit_count(F.col("h1").bitwiseXOR(x["h1"])) + F.bit_count(F.col("h2").bitwiseXOR(x["h2"]))).alias("d")
    like = lambda x: 100 * F.least(F.col("n"), x["n"]) >= params.percent * F.greatest(F.col("n"), x["n"])
    # Leaders link to those of a smaller rank, so that two of them do not link to each other only.
    others = F.filter("ahead", lambda x: (x["node"] != F.col("node")) & like(x) & (~F.col("leads") | (x["rank"] < rank)))
    joined = crowded.join(ahead, "key").withColumn("leads", F.exists("ahead", lambda x: x["node"] == F.col("node")))
    near = F.array_min(F.filter(F.transform(others, lambda x: F.struct(d(x), x["node"].alias("node"), x["root"].alias("root"))), lambda y: y["d"] <= params.radius))
    return joined.select(*crowded.columns, "leads", near.alias("leader"))


def candidate_links(nodes: DataFrame, triples: tuple[int, ...], tasks: int, tmp: Scratch, params: ShingleParams) -> DataFrame:
    """Distinct links (u, v, d) among ``nodes`` (``MEMBER`` and codes) that connect, within each key, all that lie within the radius."""

    def keyed(triples: tuple[int, ...]):
        def keys(batches):
            for b in (batch.iloc[at : at + 1000] for batch in batches for at in range(0, len(batch), 1000)):
                codes = np.frombuffer(b"".join(b["codes"]), np.int16).reshape(len(b), SEGMENTS, params.codes)
                node, root = b["node"].to_numpy(), b["root"].to_numpy()
                for triple in triples:
                    keys = triple_keys(codes, triple)
                    yield pd.DataFrame({"key": keys.ravel(), "node": np.repeat(node, keys.shape[1]), "root": np.repeat(root, keys.shape[1])})

        return nodes.select("node", "root", "codes").repartition(tasks, "node").mapInPandas(keys, "key long, node long, root long")

    step = "_".join(map(str, triples))
    # Nearly all keys have one text or one group; the others are found apart, so that Spark may broadcast them
    # while they are few, and split a large key's rows in the join.
    mixed = None
    for triple in triples:
        ends = keyed((triple,)).groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        one = tmp.table(f"mixed{triple}", ends.filter("low <> high").select("key"))
        mixed = one if mixed is None else mixed.union(one)
    shared = tmp.table(f"shared{step}", keyed(triples).select("key", "node").join(mixed, "key").join(nodes.select(*MEMBER), "node"))
    count = shared.groupBy("key").agg(F.count("*").alias("m"))
    large = count.filter(F.col("m") > params.dense)
    groups, parts, leaders = [shared], [], params.leaders
    if not large.isEmpty():
        counted = shared.join(count, "key")
        groups, crowded = [counted.filter(F.col("m") <= params.dense)], tmp.table(f"crowded{step}", counted.filter(F.col("m") > params.dense))
        while not crowded.isEmpty():
            led = tmp.table(f"led{step}_{len(parts)}", _near_leaders(crowded, leaders, params))
            parts.append(led.filter("leader is not null and root <> leader.root").select(F.least("node", "leader.node").alias("u"), F.greatest("node", "leader.node").alias("v"), "leader.d"))
            rest = led.filter("leader is null and not leads").select("key", *MEMBER)
            rest = rest.join(rest.groupBy("key").agg(F.count("*").alias("m")), "key")
            groups.append(rest.filter(F.col("m") <= params.dense))
            crowded, leaders = rest.filter(F.col("m") > params.dense), min(4 * leaders, params.dense)
    for group in groups:
        # Grouped by a hash of the key: the joins above stay free to split a large key.
        members = group.groupBy(F.xxhash64("key", F.lit(1)).alias("k")).agg(F.collect_list(F.struct(*MEMBER)).alias("members"))
        parts.append(_forest_links(members, params))
    links = parts[0]
    for more in parts[1:]:
        links = links.unionByName(more)
    out = tmp.table(f"found{step}", links.distinct())
    del mixed, ends, one, shared, count, large, groups, parts, links
    tmp.drop(*[f"mixed{triple}" for triple in triples], f"shared{step}", f"crowded{step}")
    return out


def alike(a: Column, b: Column, params: ShingleParams) -> Column:
    """Whether two sets, each the sorted 64-bit names of its shingles, are similar."""
    of = params.join()

    @F.pandas_udf("boolean")
    def of_sets(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            out.append(bool(_linked(len(p), len(q), len(np.intersect1d(p, q, assume_unique=True)), of)))
        return pd.Series(out, dtype=bool)

    return of_sets(a, b)


def simhash_links(rows: DataFrame, sets: DataFrame, tmp: Scratch, params: ShingleParams) -> DataFrame:
    """Links (u, v) of similar texts among ``sets`` (node, n, names) that the keys of their fingerprints in ``rows`` find."""
    marks = rows.select(F.col("place").alias("node"), "h1", "h2", "codes")
    nodes = tmp.table("nodes", marks.join(sets.select("node", "n"), "node").withColumn("root", F.col("node")))
    # A text makes many keys: more tasks than the rows themselves ask for.
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, nodes.count() // params.texts_each))
    links = candidate_links(nodes, params.triples, tasks, tmp, params)
    ways = links.select(F.col("u").alias("at"), "u", "v", "d").union(links.select("v", "u", "v", "d"))
    slot = F.pmod(F.xxhash64("u", "v"), F.lit(params.nearest))
    chosen = ways.groupBy("at", slot.alias("slot")).agg(F.min(F.struct("d", "u", "v")).alias("l")).select("l.u", "l.v").distinct()
    a, b = (sets.select(F.col("node").alias(c), F.col("names").alias(f"of_{c}")) for c in ("u", "v"))
    out = tmp.table("similar", chosen.join(a, "u").join(b, "v").filter(alike(F.col("of_u"), F.col("of_v"), params)).select("u", "v"))
    del marks, nodes, links, ways, chosen, a, b
    tmp.drop("nodes", "found" + "_".join(map(str, params.triples)))
    return out


def similar_groups(docs: DataFrame, tmp: Scratch, params: ShingleParams = ShingleParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root, best): for every distinct set the place of its first row, that of the first row of its group, and the
    row of the set that is to be kept.

    The result reads tables of ``tmp``.
    """
    spark, of = docs.sparkSession, params.join()
    bounded_batches(spark)
    order = spark.sparkContext.broadcast(shingle_sketch(docs, text_col, of))
    whole = docs.select(F.col("_place").alias("place"), F.col(id_col).alias("id"), described(F.col(text_col), order, params).alias("d")).select("place", "id", "d.*")
    rows = tmp.table("rows", whole)
    # What is needed once the keys of the sets, the most of a row, are done with.
    few = tmp.table("few", rows.drop("keys"))
    groups = similar_sets(docs, rows, tmp, text_col, of, lambda sets: simhash_links(few, sets, tmp, params))
    rank = F.struct(F.col("id").isNull().alias("nameless"), "id", "place")
    firsts = few.groupBy("name").agg(F.min("place").alias("node"), F.min(rank).alias("best"))
    return firsts.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "best")


def keep_one_similar(docs: DataFrame, params: ShingleParams = ShingleParams()) -> DataFrame:
    """``docs`` with one row of each group of similar texts."""
    tmp = Scratch(docs.sparkSession)
    inside, back, names = hidden(docs)
    placed = with_place(inside)
    groups = similar_groups(placed, tmp, params, names["doc_id"], names["text"])
    kept = tmp.table("kept", groups.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.place").alias("_place")))
    del groups
    tmp.keep("kept")
    # Fewer rows go than stay, and a filter of fixed size tells most that stay: their texts do not travel.
    gone = tmp.table("gone", placed.select("_place").join(kept, "_place", "left_anti"))
    marks = docs.sparkSession.sparkContext.broadcast(node_filter(gone.select(F.col("_place").alias("node"))))

    @F.pandas_udf("boolean")
    def may_go(place: pd.Series) -> pd.Series:
        return pd.Series(_passes(marks.value, place.to_numpy(np.int64)))

    stay, rest = placed.filter(~may_go("_place")), placed.filter(may_go("_place")).join(gone, "_place", "left_anti")
    return stay.select(*back).unionByName(rest.select(*back))
