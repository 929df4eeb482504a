"""Exact similarity join of texts by word shingles: a join in the metric space of the Jaccard distance.

The distance 1 - intersection / union of shingle sets is a metric, so what is known about the distances of two
texts to a third one, a pivot, bounds their own.  Two texts link within ``1 - similarity``.

Pivots: most texts are at distance 1 from any text at hand, so pivots taken from the table at large would tell
nothing, and every window would hold all texts.  Pivots are nominated instead.  Of two texts that link, each has
four fifths of its shingles in common with the other; among the rarest quarter of its shingles (by one order for
all texts), its signature, they share a twentieth.  Each such shingle nominates its first holder as a pivot, and a
text enters the region of every pivot that its shingles nominate: two texts that link meet in one region.  Texts
that share less of their signature with all others together leave, as do those that no text of their region can
equal in size.

Regions: a text's distance to its region's pivot is exact.  In a small region texts are ordered by it and a text
is compared only with those inside its window (triangle inequality, and size) that it is not yet linked to
through others.  A large region takes more pivots: every text's distance to each of them is found by a
join that Spark splits, a text goes home to the nearest (its Voronoi cell), and is replicated to the cells of
pivots whose distance is at most twice the threshold larger, where alone a partner can be at home.  Texts that
have nothing in common with any pivot, and those within the threshold of that, form a cell of their own.  Pivots
are then done with, and cells recur until they are small, or until all their texts are linked to one another.
Where windows would replicate more than they part, the region stays whole and loses its pivots only.

Links are a forest that connects exactly what all links connect.  Equal sets collapse first.

The order that says which shingles are rare is a sketch of counts over all texts, of fixed size; it decides only
how long the work takes, as any order gives the same links.  Shingles are told apart by 64-bit names.

Defined results: null texts and texts without words have an empty set and are linked with nothing; a text below
``words_each`` words is one shingle; repeated rows are equal texts; a null id is never the smallest unless all ids
of a component are null; an empty table gives an empty result; further columns stay and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Scratch, bounded_batches, hidden, with_place
from leafmill.llm.neardup import components

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Names that a worker remembers; workers outlive an operator, and what they hold counts beside the next one.
MAX_NAMES = 50_000
#: Counters of the sketch.
SKETCH_BITS = 20
SKETCH = 1 << SKETCH_BITS
#: Counters that tasks send and sum together.
_CHUNK = 1 << 16
#: A signature has one shingle in so many more than it needs to share a single one.
SPARE = 20


@dataclass(frozen=True)
class JoinParams:
    words_each: int = 5
    #: Hundredths: texts link when 100 * intersection >= percent * union.
    percent: int = 80
    #: Texts, and shingles of them together, that one task compares.
    dense: int = 2000
    dense_shingles: int = 2_000_000
    #: Pivots that a larger region takes in a round, and shingles of them together.
    pivots: int = 256
    pivot_shingles: int = 1_000_000
    #: Texts of a larger region that are compared with its pivots at once, and shingles of them together.
    block: int = 250
    block_shingles: int = 250_000
    seed: int = 42


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Names(dict):
    """64-bit names of words."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word, self.seed)
        return out


@lru_cache(1)
def _names(seed: int) -> _Names:
    """One for all batches of a worker."""
    return _Names(seed)


def shingle_set(text: str | None, names: _Names, words_each: int) -> np.ndarray:
    """Sorted 64-bit names of the distinct shingles of a text."""
    # Of bytes, only A-Z become lower case, and words end at a space and at 09 to 0D only.
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(names.__getitem__, words), np.uint64, len(words))
    width = min(words_each, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = _mixed((h + w[i : len(w) - width + 1 + i]) * _MIX)
    return np.unique(h)


def _sets(texts: pd.Series, params: JoinParams):
    names = _names(params.seed)
    for text in texts:
        if len(names) > MAX_NAMES:
            names.clear()
        yield shingle_set(text, names, params.words_each)


def _slot(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def shingle_sketch(docs: DataFrame, text_col: str, params: JoinParams) -> np.ndarray:
    """Counts of all texts' shingles by a part of their name."""

    def count(batches):
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            waiting, n = [], 0
            for names in _sets(b[text_col], params):
                waiting.append(_slot(names))
                n += len(names)
                if n > 1 << 20:
                    total += np.bincount(np.concatenate(waiting), minlength=SKETCH)
                    waiting, n = [], 0
            if waiting:
                total += np.bincount(np.concatenate(waiting), minlength=SKETCH)
        yield pd.DataFrame({"chunk": range(SKETCH // _CHUNK), "counts": [c.astype(np.uint32).tobytes() for c in total.reshape(-1, _CHUNK)]})

    out = _gathered(docs.select(text_col).mapInPandas(count, "chunk long, counts binary"), np.uint32, np.add)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def _gathered(parts: DataFrame, dtype, unite) -> np.ndarray:
    """Arrays of fixed size, one of each task in chunks (chunk, counts), united in tasks and brought to the driver."""

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b["chunk"].tolist(), b["counts"]):
                more = np.frombuffer(counts, dtype).astype(np.int64)
                sums[chunk] = unite(sums[chunk], more) if chunk in sums else more
        yield pd.DataFrame({"chunk": list(sums), "counts": [c.tobytes() for c in sums.values()]})

    chunks = SKETCH // _CHUNK
    out = np.zeros((chunks, _CHUNK), np.int64)
    for chunk, counts in parts.repartition(chunks, "chunk").mapInPandas(merge, "chunk long, counts binary").collect():  # of fixed size
        out[chunk] = np.frombuffer(counts, np.int64)
    return out.ravel()


def _bits(nodes: np.ndarray) -> np.ndarray:
    """Places of numbers in a filter of 32 bits for each counter of a sketch: four for each number."""
    h = _mixed(nodes.astype(np.int64).view(np.uint64) * _MIX)
    step = _mixed(h) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) >> np.uint64(64 - SKETCH_BITS - 5) for k in range(4)]).astype(np.int64)


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size of all numbers ``node``.

    It spares others the way; where it is full, as of a very large table, it passes all, and the join after it decides.
    """

    def build(batches):
        bits = np.zeros(SKETCH, np.uint32)
        for b in batches:
            at = _bits(b["node"].to_numpy(np.int64)).ravel()
            np.bitwise_or.at(bits, at >> 5, (np.uint32(1) << (at & 31).astype(np.uint32)))
        yield pd.DataFrame({"chunk": range(SKETCH // _CHUNK), "counts": [c.tobytes() for c in bits.reshape(-1, _CHUNK)]})

    return _gathered(nodes.mapInPandas(build, "chunk long, counts binary"), np.uint32, np.bitwise_or).astype(np.uint32)


def _passes(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = _bits(nodes)
    return (bits[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).all(axis=0)


def shared_at_least(n: Column, percent: int) -> Column:
    """How many shingles of its signature a set of ``n`` has in common with the signature of any set that it links with.

    All but ``n - percent * n / 100`` of the shingles are common, so the common ones among the rarest are that many fewer;
    the smallest partner counts.
    """
    return F.floor(F.floor(n * percent / 100) / SPARE) + 1


def signature(names: np.ndarray, order: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, as many that a set of its size that links with it has ``shared_at_least`` of them."""
    n = len(names)
    few = n - -(-percent * n // 100) + n // SPARE + 1
    if few >= n:
        return names
    rank = np.lexsort((names, order[_slot(names)]))
    return names[rank[:few]]


def _described(docs: DataFrame, text_col: str, order, params: JoinParams):
    """Column of (n, name, keys) for each text."""

    @F.pandas_udf("struct<n:long,name:binary,keys:array<long>>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        out = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s, order.value, params.percent).view(np.int64)) for s in _sets(texts, params)]
        return pd.DataFrame(out, columns=["n", "name", "keys"])

    return describe(F.col(text_col))


def overlaps(of: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Intersection sizes of the sorted set ``of`` with the sets that lie in ``flat`` at ``starts``."""
    if not len(flat) or not len(of):
        return np.zeros(len(starts), np.int64)
    at = np.minimum(np.searchsorted(of, flat), len(of) - 1)
    sums = np.concatenate([[0], np.cumsum(of[at] == flat)])
    return sums[starts + sizes] - sums[starts]


def _linked(n: np.ndarray, m: np.ndarray, both: np.ndarray, params: JoinParams) -> np.ndarray:
    return 100 * both >= params.percent * (n + m - both)


def join_region(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], params: JoinParams) -> list[tuple[int, int]]:
    """Links of a region that connect what all its links connect, but for what equal roots connect already.

    The first member is the pivot: members are ordered by their distance to it.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    # Names become small numbers, so that a set is marked in an array and others are looked up in it.
    unlike, codes = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(unlike), bool)
    both = overlaps(sets[0], flat, starts, sizes)
    distance = 1 - both / (sizes[0] + sizes - both)
    rank = np.argsort(distance, kind="stable")
    codes = np.concatenate([codes[starts[i] : starts[i] + sizes[i]] for i in rank])
    nodes, roots, sizes, distance = nodes[rank], roots[rank], sizes[rank], distance[rank]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    reach = np.searchsorted(distance, distance + (1 - params.percent / 100) + 1e-9, side="right")
    group, out = np.unique(roots, return_inverse=True)[1], []
    for i in range(len(nodes) - 1):
        j = np.arange(i + 1, reach[i])
        j = j[(group[j] != group[i]) & (100 * np.minimum(sizes[j], sizes[i]) >= params.percent * np.maximum(sizes[j], sizes[i]))]
        if not len(j):
            continue
        mark[codes[starts[i] : ends[i]]] = True
        low, high = starts[j[0]], ends[j[-1]]
        sums = np.concatenate([[0], np.cumsum(mark[codes[low:high]])])
        same = sums[ends[j] - low] - sums[starts[j] - low]
        mark[codes[starts[i] : ends[i]]] = False
        for k in j[_linked(sizes[i], sizes[j], same, params)]:
            if group[k] != group[i]:
                group[group == group[k]] = group[i]
                out.append((int(nodes[i]), int(nodes[k])))
    return out


def _joined(regions: DataFrame, params: JoinParams) -> DataFrame:
    """Links (u, v) inside each array ``members`` of (rank, node, root, names)."""

    def join(batches):
        for batch in batches:
            out = []
            for members in batch.column(0):
                m = members.values
                order = np.argsort(m.field(0).to_numpy(zero_copy_only=False), kind="stable")
                sets = [np.frombuffer(m.field(3)[int(i)].as_buffer(), np.uint64) for i in order]
                node, root = (m.field(k).to_numpy(zero_copy_only=False)[order] for k in (1, 2))
                out += join_region(node, root, sets, params)
            u, v = (np.array([x[k] for x in out], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_pydict({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return regions.select("members").mapInArrow(join, "u long, v long")


def _rank(round_: int):
    return F.xxhash64(F.lit(round_), F.col("node"))


def _compared(crowded: DataFrame, sets: DataFrame, round_: int, params: JoinParams) -> DataFrame:
    """``crowded`` (region, node, root, m, t) but for its regions' pivots, with ``linked``, the pivots it links with,
    and ``cells``: that of the nearest pivot, those whose windows the text is in, and -1 if it is far from all pivots."""
    slot = F.pmod(F.xxhash64(F.lit(-1 - round_), F.col("node")), F.lit(params.pivots))
    # Texts of roots with few members first: once compared with all of the region they are done with.
    weight = crowded.groupBy("region", "root").agg(F.count("*").alias("same"))
    led = crowded.join(weight, ["region", "root"]).groupBy("region", slot.alias("slot")).agg(F.min(F.struct("same", _rank(round_).alias("rank"), "node"))["node"].alias("node"))
    pivots = led.join(sets, "node").groupBy("region").agg(F.sort_array(F.collect_list(F.struct("node", "names"))).alias("ahead"))
    room = F.expr(f"aggregate(ahead, struct(cast(0 as long) as t, cast(0 as int) as k), (s, x) -> struct(s.t + octet_length(x.names) div 8 as t, if(s.t + octet_length(x.names) div 8 <= {params.pivot_shingles}, s.k + 1, s.k) as k)).k")
    pivots = pivots.select("region", F.slice("ahead", 1, F.greatest(room, F.lit(1))).alias("ahead"))
    blocks = F.greatest(F.ceil(F.col("m") / params.block), F.ceil(F.col("t") / params.block_shingles))
    members = crowded.join(sets.select("node", "names"), "node").groupBy("region", F.pmod(F.xxhash64("node", F.lit(round_)), blocks).alias("part")).agg(F.collect_list(F.struct("node", "root", "names")).alias("members"))
    reach = 1 - params.percent / 100 + 1e-9

    def compare(batches):
        for batch in batches:
            for region, members, ahead in zip(*(batch.column(k) for k in range(3))):
                m, a = members.values, ahead.values
                node, root = (m.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                pivot = a.field(0).to_numpy(zero_copy_only=False)
                own, of = ([np.frombuffer(x.as_buffer(), np.uint64) for x in f] for f in (m.field(2), a.field(1)))
                n, k = (np.array([len(x) for x in y], np.int64) for y in (own, of))
                flat = np.concatenate(own)
                both = np.stack([overlaps(x, flat, np.cumsum(n) - n, n) for x in of], axis=1)
                d = 1 - both / (n[:, None] + k - both)
                holds = _linked(n[:, None], k, both, params)
                home = d.min(axis=1)
                inside = (d < 1) & (d <= home[:, None] + 2 * reach)
                for i in np.flatnonzero(~np.isin(node, pivot)):
                    cells = np.flatnonzero(inside[i]).tolist() + [-1] * bool(home[i] >= 1 - reach)
                    yield region.as_py(), int(node[i]), int(root[i]), pivot[holds[i]].tolist(), cells
                # A pivot's own links to other pivots; it has no further cell.
                for i in np.flatnonzero(np.isin(node, pivot)):
                    yield region.as_py(), int(node[i]), int(root[i]), pivot[holds[i] & (pivot != node[i])].tolist(), []

    schema = pa.schema([("region", pa.int64()), ("node", pa.int64()), ("root", pa.int64()), ("linked", pa.list_(pa.int64())), ("cells", pa.list_(pa.int32()))])

    def rows(batches):
        out = []
        for row in compare(batches):
            out.append(row)
            if len(out) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return members.join(pivots, "region").select("region", "members", "ahead").mapInArrow(rows, "region long, node long, root long, linked array<long>, cells array<int>")


def _relabelled(members: DataFrame, groups: DataFrame) -> DataFrame:
    return members.drop("root").join(groups.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("root", "node")).drop("_n")


def similar_sets(docs: DataFrame, rows: DataFrame, tmp: Scratch, text_col: str, params: JoinParams, known: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of all sets that link, from ``rows`` (place, n, name, keys) of ``docs``; a set's node is the place of its first row.

    ``known`` gives links (u, v) found by other means among the sets (node, n, names) that may link; what they connect is
    not compared again.
    """
    firsts = rows.filter("n > 0").groupBy("name").agg(F.min("place").alias("node"), F.first("keys").alias("keys"))
    keyed = firsts.select(F.explode("keys").alias("key"), "node")
    # The pivot that a shingle nominates is its holder that comes first in the table, in no order that the texts know.
    shared = keyed.groupBy("key").agg(F.min("node").alias("region"), F.max("node").alias("last")).filter("region < last").select("key", "region")
    members = tmp.table("members", keyed.join(shared, "key").groupBy("region", "node").agg(F.count("*").alias("keys")))
    # A text that shares too few of its signature links with no other.
    sums = members.groupBy("node").agg(F.sum("keys").alias("keys"))
    sized = rows.select(F.col("place").alias("node"), "n").join(sums, "node").filter(F.col("keys") >= shared_at_least(F.col("n"), params.percent))
    # Sizes in bands, of which a text can link with its own and the two beside it only.
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / params.percent)) + 1e-9).cast("int")
    sizes = tmp.table("sizes", sized.select("node", "n", band.alias("band")))
    del firsts, keyed, shared, sums, sized
    tmp.drop("rows")
    held = members.join(sizes, "node").select("region", "node", "band")
    counts = held.groupBy("region", "band").agg(F.count("*").alias("m"))
    near = counts.select("region", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"), "m").groupBy("region", "band").agg(F.sum("m").alias("m"))
    members = tmp.table("regions", held.join(near.filter("m > 1"), ["region", "band"]).select("region", "node"))
    ends = tmp.table("ends", members.select("node").distinct().join(sizes.select("node", "n"), "node"))
    wanted = docs.sparkSession.sparkContext.broadcast(node_filter(ends.select("node")))

    def named(batches):
        for b in batches:
            b = b[_passes(wanted.value, b["_place"].to_numpy(np.int64))]
            yield pd.DataFrame({"node": b["_place"], "names": [s.tobytes() for s in _sets(b[text_col], params)]})

    # Sets are made where the texts lie, so that no text travels.
    sets = tmp.table("sets", docs.select("_place", text_col).mapInPandas(named, "node long, names binary").join(ends, "node").select("node", "n", "names"))
    tmp.drop("members", "sizes", "ends")
    # A pivot is a member of its own region.
    work, links, groups, round_ = members.withColumn("root", F.col("node")), [], None, 0
    if known is not None:
        first = groups = tmp.table("groups", components(known(sets)))
        links.append(groups.select(F.col("root").alias("u"), F.col("node").alias("v")))
        work = tmp.table("work", _relabelled(work, groups).select("region", "node", "root"))
    while True:
        large = work.join(sets.select("node", "n"), "node").groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("t"), F.min("root").alias("low"), F.max("root").alias("high"))
        large = tmp.table(f"large{round_}", large.filter("m > 1 and low <> high"))
        crowded = (F.col("m") > params.dense) | ((F.col("t") > params.dense_shingles) & (F.col("m") > 2))
        small = work.join(large.filter(~crowded).select("region"), "region").join(sets, "node")
        order = F.when(F.col("node") == F.col("region"), F.lit(-(2**63))).otherwise(_rank(round_))
        regions = small.groupBy("region").agg(F.collect_list(F.struct(order.alias("rank"), "node", "root", "names")).alias("members"))
        links.append(tmp.table(f"links{round_}", _joined(regions, params).distinct()))
        if large.filter(crowded).isEmpty():
            break
        near = tmp.table(f"near{round_}", _compared(work.join(large.filter(crowded).select("region", "m", "t"), "region"), sets, round_, params))
        close = near.select(F.col("node"), F.explode("linked").alias("v"))
        links.append(tmp.table(f"close{round_}", close.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()))
        groups = tmp.table(f"groups{round_}", components(_union(links)))
        # Pivots are done with.  Regions that their windows do not part stay whole.
        left = _relabelled(near.filter(F.size("cells") > 0), groups)
        parted = left.groupBy("region").agg((F.sum(F.size("cells")) <= 2 * F.count("*")).alias("parts"))
        left = left.join(parted, "region")
        cells = left.filter("parts").select("region", "node", "root", F.explode("cells").alias("cell"))
        whole = left.filter("not parts").select("region", "node", "root")
        work = tmp.table(f"work{round_}", cells.select(F.xxhash64("region", "cell", F.lit(round_)).alias("region"), "node", "root").union(whole))
        round_ += 1
    return components(_union(links)) if known is None else merged(first, _union(links[1:]))


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of ``groups`` with the links added; only the groups that links touch are gone through again."""
    for c in ("u", "v"):
        links = links.join(groups.select(F.col("node").alias(c), F.col("root").alias(f"of_{c}")), c, "left")
    more = components(links.select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v")))
    moved = groups.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(more.join(groups, "node", "left_anti").select("node", "root"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def jaccard_join(docs: DataFrame, params: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_shingles``, the size of the text's set, and ``component_id``, the smallest id that links reach."""
    spark = docs.sparkSession
    bounded_batches(spark)
    tmp = Scratch(spark)
    inside, back, names = hidden(docs, "n_shingles", "component_id")
    placed, text, id_ = with_place(inside), names[text_col], names[id_col]
    order = spark.sparkContext.broadcast(shingle_sketch(placed, text, params))
    rows = tmp.table("rows", placed.select(F.col("_place").alias("place"), F.col(id_).alias("id"), _described(placed, text, order, params).alias("d")).select("place", "id", "d.*"))
    few = tmp.table("few", rows.select("place", "id", "n", "name"))
    groups = similar_sets(placed, rows, tmp, text, params)
    rows = few
    of_name = rows.filter("n > 0").groupBy("name").agg(F.min("place").alias("node"), F.min("id").alias("first"))
    named = tmp.table("named", of_name.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")))
    smallest = named.groupBy("root").agg(F.min("first").alias("smallest"))
    labels = named.join(smallest, "root").select("name", "smallest")
    found = rows.select("place", "id", "n", "name").join(labels, "name", "left")
    found = tmp.table("found", found.select(F.col("place").alias("_place"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("id")).alias("component_id")))
    tmp.keep("found")
    return placed.join(found, "_place").select(*back, "n_shingles", "component_id")
