"""Search of many texts for many patterns at once: an index of each block of patterns by their rarest eight bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.plan import bounded_batches, cut

MAX_TASKS = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = b"\xff"  # in no UTF-8


@dataclass(frozen=True)
class IndexParams:
    #: Characters of patterns that are sent to all workers; more are dealt with the texts.
    broadcast_chars: int = 4_000_000
    #: Characters of patterns in one index of the second way, and texts of a group, and their characters, in one of its parts.
    block_chars: int = 16_000_000
    texts_each: int = 50_000
    chars_each: int = 100_000_000


def _grams(data: bytes) -> np.ndarray:
    """The eight bytes from each place of ``data`` but the last seven, as numbers."""
    out = np.empty(max(len(data) - 7, 0), np.uint64)
    for k in range(8):
        some = out[k::8]
        some[:] = np.frombuffer(data, "<u8", len(some), k) if len(some) else 0
    return out


def _low(n: np.ndarray) -> np.ndarray:
    """Masks of the first ``n`` of eight bytes."""
    n = np.clip(n, 0, 8).astype(np.uint64)
    return np.where(n == 8, np.uint64(2**64 - 1), (np.uint64(1) << (n * np.uint64(8) & np.uint64(63))) - np.uint64(1))


class _Index:
    """Patterns (UTF-8) with their values; of a pattern's values the smallest counts.

    A pattern is told by its anchor: the eight bytes of it that fewest patterns hold, or all of a shorter one.  A place of a
    text whose bytes are an anchor is compared with the anchor's patterns, eight bytes at a time.
    """

    def __init__(self, patterns: list[bytes], values: np.ndarray, table_bits: int = 22, pairs: int = 1 << 20):
        self.pairs, self.table_bits, self.values, self.everywhere = pairs, table_bits, values, -1
        size = np.fromiter(map(len, patterns), np.int64, len(patterns))
        empty = np.flatnonzero(size == 0)
        if len(empty):
            self.everywhere = int(empty[np.argmin(values[empty])])
        self.size, words = size, (size + 7) // 8
        self.first = np.cumsum(words) - words
        self.words = np.frombuffer(b"".join(p.ljust(8 * -(-len(p) // 8), b"\0") for p in patterns), "<u8")
        self.anchors = []
        anchor, at = np.zeros(len(patterns), np.uint64), np.zeros(len(patterns), np.int64)
        long = np.flatnonzero(size >= 8)
        if len(long):
            data = b"".join(patterns[i] for i in long)
            grams, each = _grams(data), size[long] - 7
            start = np.cumsum(size[long]) - size[long]
            place = np.repeat(start - (np.cumsum(each) - each), each) + np.arange(each.sum())
            slot = self._slot(grams[place])
            often = np.bincount(slot, minlength=1 << table_bits)[slot]
            # The first of a pattern's rarest ones.
            low = np.minimum.reduceat(often, np.cumsum(each) - each)
            hit = np.flatnonzero(often == np.repeat(low, each))
            owner, where = np.unique(np.repeat(np.arange(len(long)), each)[hit], return_index=True)
            chosen = place[hit[where]]
            anchor[long[owner]], at[long[owner]] = grams[chosen], chosen - start[owner]
        for n in sorted(set(np.minimum(size, 8).tolist()) - {0}):
            own = np.flatnonzero(np.minimum(size, 8) == n)
            anchor[own] = anchor[own] if n == 8 else self.words[self.first[own]]
            own = own[np.argsort(anchor[own], kind="stable")]
            keys, begin, count = np.unique(anchor[own], return_index=True, return_counts=True)
            table = np.zeros(1 << table_bits, bool)
            table[self._slot(keys)] = True
            self.anchors.append((n, own, keys, begin, count, table))
        self.at, self.front = at, int(at.max(initial=0))

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * _MIX) >> np.uint64(64 - self.table_bits)).astype(np.int64)

    def least(self, texts: list[bytes]) -> np.ndarray:
        """For each text the number of its pattern with the smallest value, or -1."""
        best = np.full(len(texts), self.everywhere, np.int64)
        if not self.anchors or not texts:
            return best
        pad = int(self.size.max()) + 16
        data = _END * self.front + b"".join(t + _END for t in texts) + _END * pad
        ends = self.front + np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        grams = _grams(data)
        for n, own, keys, begin, count, table in self.anchors:
            for low in range(self.front, int(ends[-1]), self.pairs):
                here = grams[low : min(low + self.pairs, int(ends[-1]))]
                here = here if n == 8 else here & _low(np.array([n]))[0]
                place = np.flatnonzero(table[self._slot(here)])
                k = np.searchsorted(keys, here[place])
                k[k == len(keys)] = 0
                same = keys[k] == here[place]
                place, k = place[same] + low, k[same]
                pairs, since = np.cumsum(count[k]), 0
                while since < len(place):
                    before = pairs[since - 1] if since else 0
                    to = max(since + 1, int(np.searchsorted(pairs, before + self.pairs, "right")))
                    self._compare(grams, ends, place[since:to], begin[k[since:to]], count[k[since:to]], own, best)
                    since = to
        return best

    def _compare(self, grams: np.ndarray, ends: np.ndarray, place: np.ndarray, begin: np.ndarray, count: np.ndarray, own: np.ndarray, best: np.ndarray) -> None:
        """Pairs of a place and each of ``count`` patterns from ``begin``: those that fit and are smaller go to ``best``."""
        which = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        p = own[which]
        text, start = np.repeat(np.searchsorted(ends, place, "right"), count), np.repeat(place, count) - self.at[p]
        now = best[text]
        smaller = (now < 0) | (self.values[p] < self.values[now])
        p, text, start = p[smaller], text[smaller], start[smaller]
        word = 0
        alive = np.arange(len(p))
        fits = np.ones(len(p), bool)
        while len(alive):
            left = self.size[p[alive]] - 8 * word
            alive, left = alive[left > 0], left[left > 0]
            if len(alive):
                ok = grams[start[alive] + 8 * word] & _low(left) == self.words[self.first[p[alive]] + word]
                fits[alive[~ok]] = False
                alive = alive[ok]
            word += 1
        p, text = p[fits], text[fits]
        order = np.lexsort((self.values[p], text))
        text, p = text[order], p[order]
        lead = np.flatnonzero(np.diff(text, prepend=-1))
        best[text[lead]] = p[lead]


def _bytes(texts) -> list[bytes]:
    return [t if isinstance(t, bytes) else bytes(t) for t in texts]


_FOUND = "struct<value:long,shown:string>"


def _sent(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """``rows`` with ``found``, by the indexes of all groups, built once in each worker."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast([tuple(r) for r in patterns.select("group", F.encode("pattern", "UTF-8").alias("pattern"), "value", "shown").collect()])  # counted by the caller
    built: dict = {}

    @F.pandas_udf(_FOUND)
    def find(group: pd.Series, text: pd.Series) -> pd.DataFrame:
        if not built:
            by: dict = {}
            for g, *pattern in sent.value:
                by.setdefault(g, []).append(pattern)
            built.update({g: (_Index(_bytes(p for p, _, _ in some), np.array([v for _, v, _ in some], np.int64)), some) for g, some in by.items()})
        out: list = [(None, None)] * len(text)
        for g, (index, some) in built.items():
            at = np.flatnonzero((group == g) & text.notna())
            for i, p in zip(at.tolist(), index.least(_bytes(text.iloc[at])).tolist() if len(at) else ()):
                if p >= 0:
                    out[i] = (some[p][1], some[p][2])
        return pd.DataFrame(out, columns=["value", "shown"]).astype({"value": "Int64"})

    return rows.withColumn("found", find("group", F.encode("text", "UTF-8")))


def _dealt(rows: DataFrame, patterns: DataFrame, params: IndexParams) -> DataFrame:
    """(group, name, found) of the texts with a pattern: each group's patterns in blocks; a part of the group's texts meets each block.

    Patterns come before the texts in the sorted shuffle, so that a task holds one index and streams the texts
    past it.  The parts of a group and its blocks grow with it, and so do the tasks: what one of them reads does not.
    """
    size = patterns.groupBy("group").agg(F.sum(F.length("pattern") + 1).alias("chars"))
    counts = rows.filter("text is not null").groupBy("group").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("texts")).join(size, "group")
    parts = F.greatest(F.ceil(F.col("n") / params.texts_each), F.ceil(F.col("texts") / params.chars_each))
    plan = cut(counts.select("group", F.ceil(F.col("chars") / params.block_chars).alias("blocks"), parts.alias("parts")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    utf8 = lambda c: F.encode(c, "UTF-8")
    p = patterns.join(F.broadcast(plan), "group").select("group", F.pmod(F.xxhash64("pattern"), "blocks").alias("block"), every("parts").alias("part"), F.lit(0).alias("kind"), "value", "shown", F.lit(None).cast("binary").alias("name"), utf8("pattern").alias("text"))
    # By the whole row (maps have no hash), so that copies of a text are not in one part.
    whole = [f.name for f in rows.schema["row"].dataType if "map<" not in f.dataType.simpleString()]
    t = rows.filter("text is not null").join(F.broadcast(plan), "group").select("group", every("blocks").alias("block"), F.pmod(F.xxhash64("text", *[F.col("row")[c] for c in whole]), "parts").alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("value"), F.lit(None).cast("string").alias("shown"), "name", utf8("text").alias("text"))
    kind = rows.schema["group"].dataType.simpleString()

    def find(batches):
        now, known, index, shown = None, [], None, []
        for b in batches:
            out = []
            key = pd.DataFrame({k: b[k] for k in ("group", "block", "part", "kind")})
            new = (key != key.shift()).any(axis=1).to_numpy()
            cuts = [*np.flatnonzero(new).tolist(), len(b)]
            for run in (b.iloc[i:j] for i, j in zip(cuts, cuts[1:])):
                group, block, part, of = run[["group", "block", "part", "kind"]].iloc[0]
                if (group, block, part) != now:
                    now, known, index = (group, block, part), [], None
                if of == 0:
                    known.append((_bytes(run["text"]), run["value"].to_numpy(np.int64), run["shown"].tolist()))
                    continue
                if index is None:
                    index = _Index([p for ps, _, _ in known for p in ps], np.concatenate([np.zeros(0, np.int64), *[v for _, v, _ in known]]))
                    shown, known = [s for _, _, ss in known for s in ss], []
                least = index.least(_bytes(run["text"]))
                out += [(group, name, int(index.values[k]), shown[k]) for name, k in zip(run["name"], least.tolist()) if k >= 0]
            yield pd.DataFrame(out, columns=["group", "name", "value", "shown"])

    meetings = plan.agg(F.sum(F.col("blocks") * F.col("parts"))).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, 2 * meetings))
    both = p.union(t).repartition(tasks, "group", "block", "part").sortWithinPartitions("group", "block", "part", "kind")
    hits = both.mapInPandas(find, f"group {kind}, name binary, value long, shown string")
    return hits.groupBy("group", "name").agg(F.min(F.struct("value", "shown")).alias("found"))


def least_pattern(df: DataFrame, group: Column, text: Column, patterns: DataFrame, name: str, params: IndexParams = IndexParams()) -> DataFrame:
    """``df`` with ``name``: value and ``shown`` of the smallest value among the patterns of its group that the text holds.

    ``patterns``: group, pattern, value (long), shown (string).  Each text is read once, whatever the number of patterns: by the
    indexes of all groups where the patterns are few by their counted characters, else by those of its group, block by block.
    A null text, group or pattern matches nothing; the empty pattern is in every text; of equal patterns of a group the
    smallest value counts, and of its rows the smallest ``shown``.
    """
    bounded_batches(df.sparkSession)
    one = F.min(F.struct("value", "shown")).alias("v")
    known = patterns.filter("group is not null and pattern is not null and value is not null").groupBy("group", "pattern").agg(one).select("group", "pattern", "v.value", "v.shown")
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), group.alias("group"), text.alias("text"))
    chars = known.agg(F.sum(F.length("pattern") + 40).alias("n")).first()["n"] or 0
    if chars <= params.broadcast_chars:
        found = _sent(rows, known)
    else:
        rows = rows.withColumn("name", F.unhex(F.sha2("text", 256)))
        found = rows.join(_dealt(rows, known, params), ["group", "name"], "left")
    return found.select("row.*", F.col("found").alias(name))
