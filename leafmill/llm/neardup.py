"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into three segments.  Two fingerprints that differ in at most two bits
agree exactly in one segment at least (pigeonhole), and differ in at most two bits in the next one.
That next segment is hashed by the perfect binary Golay code of 23 bits: a segment gets the index of
the codeword nearest to it and to each of its 23 neighbours (one key or six).  Two segments at distance
two or less have a neighbour in common, so they share a key.  Fingerprints join on (segment, its exact
value, Golay key of the next) and are verified by their true distance.

Scale: copies collapse into one fingerprint before anything is compared.  A key held by more than
``dense`` fingerprints is not compared pair by pair: its fingerprints are linked through the points at
distance one (65 each; two fingerprints share such a point exactly if they differ in two bits or
fewer), so no group ever grows with the square of its size and none is cut short.  Components are
found by randomised contraction in a logarithmic number of rounds, each cut by a checkpoint.

Defined results: a null or empty text has fingerprint zero and links like any other; a null id is
never the smallest unless all ids of the component are null; repeated rows are copies of each other;
an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import SPACE_WORD, bounded_batches, cut, hidden, lower_ascii, with_place

#: Low bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code (23, 12, 7); a fixed value.
GENERATOR = 0xC75
MAX_DISTANCE = 2
#: Rows that fill a partition of the contracted graph.
ROWS_EACH = 50_000
#: Fingerprints that may be called hot.
MAX_HOT = 1000


@lru_cache(1)
def _syndromes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits, and the error (three bits at most) of each syndrome."""

    def syndrome(x: int) -> int:
        for b in range(22, 10, -1):
            if x >> b & 1:
                x ^= GENERATOR << (b - 11)
        return x

    low = np.array([syndrome(x) for x in range(1 << 12)], np.uint32)
    high = np.array([syndrome(x << 12) for x in range(1 << 11)], np.uint32)
    error = np.zeros(1 << 11, np.uint32)
    for k in range(4):
        for bits in combinations(range(23), k):
            e = sum(1 << b for b in bits)
            error[syndrome(e)] = e
    return low, high, error


def decode(x: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    low, high, error = _syndromes()
    x = x.astype(np.uint32)
    return (x ^ error[low[x & 0xFFF] ^ high[x >> 12]]) >> 11


def codewords() -> np.ndarray:
    """The 4096 codewords, by index."""
    low, high, _ = _syndromes()
    x = np.arange(1 << 12, dtype=np.uint32) << 11
    return x ^ low[x & 0xFFF] ^ high[x >> 12]


def golay_keys(segment: np.ndarray) -> np.ndarray:
    """For each 23-bit word the indices of the codewords nearest to it and its neighbours, sorted; repeats are -1."""
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
    keys = np.sort(decode(segment.astype(np.uint32)[:, None] ^ flips[None, :]).astype(np.int64), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: every key of every fingerprint."""
    rows, keys = [], []
    part = [(fps >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    for i in range(3):
        g = golay_keys(part[(i + 1) % 3])
        r, c = np.nonzero(g >= 0)
        rows.append(r)
        keys.append((np.int64(i) << 40) | (part[i].astype(np.int64)[r] << 12) | g[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def simhash(text: str | None, words_each: int = 3, seed: int = 42) -> int:
    words = SPACE_WORD.findall(lower_ascii(text)) if isinstance(text, str) else []
    if not words:
        return 0
    shingles = map(" ".join, zip(*(words[i:] for i in range(words_each)))) if len(words) >= words_each else [" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: Column) -> Column:
    """The SimHash of ``text`` as a signed long."""

    @F.pandas_udf("long")
    def of_texts(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t) for t in texts], np.uint64).view(np.int64))

    return of_texts(text)


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what a small bucket connects, each verified by its distance."""
    u = fps.astype(np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= MAX_DISTANCE
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[b] = a
            out.append((int(fps[i]), int(fps[j])))
    return out


def links(fps: DataFrame, dense: int = 64) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that connect all at distance two or less."""

    def keyed(batches):
        for b in batches:
            v = b["fp"].to_numpy(np.int64)
            rows, keys = fuzzy_keys(v.view(np.uint64))
            yield pd.DataFrame({"key": keys, "fp": v[rows]})

    def midpoints(batches):
        flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for b in batches:
            v = b["fp"].to_numpy(np.int64)
            yield pd.DataFrame({"key": (v.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64), "fp": np.repeat(v, 65)})

    @F.pandas_udf("array<struct<u:long,v:long>>")
    def forest(groups: pd.Series) -> pd.Series:
        return pd.Series([_forest(np.asarray(g)) for g in groups])

    keys = fps.mapInPandas(keyed, "key long, fp long")
    # Counted apart, so that Spark may split a large key's rows in the join.
    counted = cut(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n >= 2"))
    shared = keys.join(counted, "key")
    # And grouped by a hash of the key, for the same reason.
    buckets = shared.filter(F.col("n") <= dense).groupBy(F.xxhash64("key").alias("k")).agg(F.collect_list("fp").alias("fps"))
    few = buckets.select(F.explode(forest("fps")).alias("l")).select("l.u", "l.v")
    many = shared.filter(F.col("n") > dense).select("fp").distinct().mapInPandas(midpoints, "key long, fp long")
    stars = many.groupBy("key").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return few.union(stars.select("u", F.explode("fps").alias("v"))).filter("u <> v").distinct()


def packed(df: DataFrame, rows: int, each: int = ROWS_EACH) -> DataFrame:
    """``df``, known to have ``rows`` at most, in no more partitions than these fill: few rows in many files cost disk, not time."""
    return df.coalesce(max(1, -(-rows // each))) if rows < each * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the smallest node that it is connected to.

    Randomised contraction: in each round every node goes to that of its neighbours and itself which has the
    smallest hash of the round, and links between nodes that went to the same place disappear.  A constant
    share of the nodes goes in each round whatever the graph's shape, so that the rounds grow with the
    logarithm of the number of nodes.
    """
    edges = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left, steps = cut(edges), []
    while links := left.count():
        # Each link has two ends at most, and the links of one round bound those of the next.
        rank = lambda c, k=len(steps): F.struct(F.xxhash64(F.lit(k), c).alias("h"), c.alias("x"))
        left = packed(left, links)
        nearest = left.union(left.select("v", "u")).groupBy("u").agg(F.min(rank(F.col("v"))).alias("m"))
        step = cut(packed(nearest.select(F.col("u").alias("node"), F.least(rank(F.col("u")), "m")["x"].alias("to")), 2 * links))
        of = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        moved = left.join(of("u"), "u").join(of("v"), "v").filter("u_to <> v_to")
        left = cut(packed(moved.select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).distinct(), links))
        steps.append((step, 2 * links))
        del nearest, moved
        # Spark removes the shuffle files of finished rounds once the driver has forgotten their plans.
        left.sparkSession.sparkContext._jvm.System.gc()
    if not steps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    # Back through the rounds, each with more nodes than the one after it.
    ends, most = steps.pop()
    for step, most in reversed(steps):
        ends = cut(packed(step.join(ends.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left").select("node", F.coalesce("end", "to").alias("to")), most))
    smallest = ends.groupBy("to").agg(F.min("node").alias("root"))
    return cut(packed(ends.join(smallest, "to").select("node", "root"), most))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), dense: int = 64) -> DataFrame:
    """One row per document: its id, ``extra`` columns, the fingerprint ``fp`` and its component's smallest id."""
    bounded_batches(docs.sparkSession)
    d = cut(docs.select(F.col(id_col).alias("id"), *extra, fingerprint(F.col(text_col)).alias("fp")))
    firsts = cut(d.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    copies = d.count() / MAX_HOT
    roots = components(links(firsts.select("fp"), dense))
    linked = roots.join(firsts, roots["node"] == firsts["fp"]).select("fp", "root", "first")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of_linked = linked.join(smallest, "root").select("fp", "component_id")
    of_fp = firsts.join(of_linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))
    # Fingerprints with a thousandth of all rows or more are a thousand at most: they are broadcast, so that
    # the copies of one text need not meet in one task.
    hot = F.broadcast(of_fp.filter(F.col("n") >= copies).select("fp", F.lit(True).alias("is_hot"), F.col("component_id").alias("hot_id")))
    marked = d.join(hot, "fp", "left")
    rare = marked.filter("is_hot is null").select(*d.columns).join(of_fp.filter(F.col("n") < copies).select("fp", "component_id"), "fp")
    names = ("id", *extra, "fp", "component_id")
    found = marked.filter("is_hot").withColumn("component_id", F.col("hot_id")).select(*names).unionByName(rare.select(*names))
    return found.withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the first row that bears the group's smallest id.

    Rows are told apart by their place in the scan, as ids may repeat.
    """
    inside, back, names = hidden(docs)
    placed = with_place(inside)
    found = near_duplicates(placed, names["doc_id"], names["text"], extra=("_place",)).withColumnRenamed(names["doc_id"], "doc_id")
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id", "doc_id").agg(F.min("_place").alias("_place"))
    nameless = found.filter("component_id is null").groupBy("fp").agg(F.min("_place").alias("_place"))
    places = chosen.filter("component_id is not null").select("_place").union(nameless.select("_place"))
    return placed.join(places, "_place", "left_semi").select(*back)
