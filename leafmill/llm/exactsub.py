"""Exact substring removal: suffixes are told apart by bucket-pointer refinement, 200 bytes deep.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else in the corpus.
Two suffixes agree on that many bytes exactly if they stay in one bucket while buckets are refined:

1. Initial buckets.  Every window of ``length`` bytes is named by its smallest q-gram (by hash, leftmost
   among equals), so equal windows lie at one offset of q-grams of one bucket.  Consecutive windows with
   one such q-gram are one *anchor*: about one for 90 bytes.  Anchors alone in their bucket are done.
2. Anchors are refined by the identifier of all that their windows cover.  Equal ones repeat as a whole.
3. The others are cut into blocks of offsets.  A block's bucket is refined by the identifier of the bytes
   that all its windows share, which starts at a later offset, and then by that of all its bytes.
4. Blocks that share the former but not the latter are refined once more, window by window.

Where a bucket splits into equal and unequal members, one of the equal ones goes on as their witness, so
the work that was done is reused and not repeated.  Identifiers name contents (64 bits of a rolling hash inside
a bucket of 64 bits, and two hashes for windows) instead of being ranks: they need no global order, so every
step is a count with map-side aggregation, however large a bucket is, and nothing collects a bucket.

Defined results: a null or empty text has no bytes; texts below ``length`` lose nothing; repeated rows
are copies and repeat each other; an empty table gives an empty result; columns of the input named like
a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Scratch, bounded_batches, hidden, with_place

U = np.uint64
ANCHOR = "place long, lo int, hi int, off int, h long, c long"
SPAN = "array<struct<start:long,end:long>>"
RESULT = f"n_bytes long, spans {SPAN}, kept binary"


@dataclass(frozen=True)
class RepeatParams:
    length: int = 200
    #: Bytes of the initial q-grams, and offsets in a block.
    gram: int = 32
    block: int = 16


#: Windows of one text are handled in pieces of so many.
PIECE = 1 << 20


@lru_cache(2)
def _tables(which: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(20_000 + which)
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1), int(rng.integers(0, 1 << 62)) * 4 + 3


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a hash's base and of its inverse modulo 2^64."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size, base = 1 << max(12, (n - 1).bit_length()), _tables(which)[1]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        _POWERS[which] = tuple(both)
    return _POWERS[which]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Names:
    """Names of any stretches of ``data``, by one of two hashes."""

    def __init__(self, data: np.ndarray, which: int):
        self.table, self.n = _tables(which)[0], len(data)
        power, self.inverse = _powers(which, self.n + 1)
        self.sums = np.zeros(self.n + 1, U)
        np.cumsum(self.table[data] * power[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U))

    def grams(self, q: int) -> np.ndarray:
        return _mix((self.sums[q:] - self.sums[:-q]) * self.inverse[: self.n - q + 1])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    padded = np.full(-(-len(x) // w) * w, np.iinfo(U).max, U)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, p: RepeatParams) -> list[tuple]:
    """Arrays (lo, hi, off, h, c) of a text: window starts lo to hi have their q-gram at lo + off; c names all their bytes."""
    out = []
    for at in range(0, len(data) - p.length + 1, PIECE):
        b = data[at : at + PIECE + p.length - 1]
        one = Names(b, 0)
        grams = one.grams(p.gram)
        low = U((1 << 21) - 1)
        least = _window_min((grams & ~low) | np.arange(len(grams), dtype=U), p.length - p.gram + 1)
        place = (least & low).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        hi = np.append(lo[1:], len(place)) - 1
        out.append((lo + at, hi + at, place[lo] - lo, grams[place[lo]], one.of(lo, hi + p.length)))
    return out


def _bytes(text) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"", np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _stretches(rows: pd.DataFrame, size: int = 1 << 20):
    """Rows with their bytes end to end, in parts of about ``size`` bytes: (rows, data, where each starts)."""
    lengths = rows["data"].map(len).to_numpy(np.int64)
    ends = np.cumsum(lengths)
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(ends // size)) + 1):
        if len(part):
            some = rows.iloc[part]
            yield some, np.frombuffer(b"".join(some["data"]), np.uint8), ends[part] - lengths[part] - (ends[part[0]] - lengths[part[0]])


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of all numbers first to last of every row."""
    count = last - first + 1
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]


def find_repeats(placed: DataFrame, tmp: Scratch, p: RepeatParams = RepeatParams(), text_col: str = "text") -> DataFrame:
    """(place, lo, hi): the window starts lo to hi of row ``place`` whose windows start elsewhere too.

    The result reads tables of ``tmp``.
    """

    def all_anchors(batches):
        for batch in batches:
            parts = [(np.full(len(a[0]), place), *a) for place, text in zip(batch["place"], batch["text"]) for a in anchors(_bytes(text), p)]
            if parts:
                place, lo, hi, off, h, c = (np.concatenate(x) for x in zip(*parts))
                yield pd.DataFrame({"place": place, "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "off": off.astype(np.int32), "h": _signed(h), "c": _signed(c)})

    def contexts(batches):
        for batch in batches:
            rows = []
            for place, text, wanted in zip(batch["place"], batch["text"], batch["wanted"]):
                data = text.encode("utf-8", "surrogatepass")
                rows += [(place, w["lo"], w["hi"], w["off"], w["h"], w["open"], data[w["lo"] : w["hi"] + p.length]) for w in wanted]
            yield pd.DataFrame(rows, columns=["place", "lo", "hi", "off", "h", "open", "data"])

    def blocks(batches):
        core = p.length - p.block + 1
        for batch in batches:
            for some, data, start in _stretches(batch):
                lo, hi, off = (some[c].to_numpy(np.int64) for c in ("lo", "hi", "off"))
                # Offsets of the q-gram in the windows: from off - (hi - lo) to off.
                row, b = _ranges((off - (hi - lo)) // p.block, off // p.block)
                most = np.minimum(b * p.block + p.block - 1, off[row])
                least = np.maximum(b * p.block, (off - (hi - lo))[row])
                begin = start[row] + off[row]
                names = Names(data, 0)
                s, e, c = begin - most, begin - least + p.length, begin - b * p.block
                key = _mix(names.of(c, c + core) + _mix(some["h"].to_numpy(np.int64)[row].view(U)) + b.astype(U))
                yield pd.DataFrame({"place": some["place"].to_numpy()[row], "lo": (lo + off)[row] - most, "hi": (lo + off)[row] - least, "open": some["open"].to_numpy()[row], "key": _signed(key), "c": _signed(names.of(s, e))}).astype({"lo": np.int32, "hi": np.int32})

    def windows(batches):
        for batch in batches:
            for some, data, start in _stretches(batch):
                rows = [(i, w["lo"], w["hi"], w["open"]) for i, ws in enumerate(some["wanted"]) for w in ws]
                owner, first, last = (np.array([r[k] for r in rows], np.int64) for k in range(3))
                row, s = _ranges(first, last)
                at = start[owner[row]] + s - some["lo"].to_numpy(np.int64)[owner[row]]
                yield pd.DataFrame({"place": some["place"].to_numpy()[owner[row]], "lo": s.astype(np.int32), "open": np.array([r[3] for r in rows], bool)[row], "w1": _signed(Names(data, 0).of(at, at + p.length)), "w2": _signed(Names(data, 1).of(at, at + p.length))})

    docs = placed.select("place", F.col(text_col).alias("text")).filter(F.octet_length("text") >= p.length)
    every = docs.mapInPandas(all_anchors, ANCHOR)
    # Counts are tables of their own, so that Spark may split a large bucket's rows in the joins.
    twins = tmp.table("twins", every.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    shared = tmp.table("shared", every.join(twins, "h"))
    del every

    # 2. What an anchor covers, as a whole.
    member = F.struct("place", "lo", "hi", "off", "h").alias("m")
    whole = tmp.table("whole", shared.groupBy(F.xxhash64("h", "c").alias("k"), "c").agg(F.count("*").alias("n"), F.min(member).alias("m")).select("n", "m.*"))
    alone = whole.filter("n = 1").drop("n")
    repeated = tmp.table("repeated", shared.join(alone.select("place", "lo"), ["place", "lo"], "left_anti").select("place", "lo", "hi"))
    unsure = tmp.table("unsure", alone.select("h").distinct())
    witness = whole.filter("n > 1").drop("n").join(unsure, "h", "left_semi")
    wanted = alone.withColumn("open", F.lit(True)).unionByName(witness.withColumn("open", F.lit(False)))
    tmp.drop("shared", "twins")

    # 3. Blocks of offsets. From here on the bytes that the windows cover travel with the anchors.
    lists = wanted.groupBy("place").agg(F.collect_list(F.struct("lo", "hi", "off", "h", "open")).alias("wanted"))
    spread = tmp.table("spread", docs.join(lists, "place").mapInPandas(contexts, "place long, lo int, hi int, off int, h long, open boolean, data binary"))
    del shared, twins, unsure, alone, witness, wanted, lists
    tmp.drop("whole", "unsure")
    cutup = tmp.table("cutup", spread.mapInPandas(blocks, "place long, lo int, hi int, open boolean, key long, c long"))
    classes = cutup.groupBy(F.xxhash64("key", "c").alias("k"), "key", "c").agg(F.count("*").alias("n"), F.max("open").alias("open"), F.min(F.struct("place", "lo", "hi", "open")).alias("m"))
    classes = tmp.table("classes", classes.select("key", "c", "n", "open", "m"))
    same = tmp.table("same", cutup.filter("open").join(classes.filter("n > 1 and open").select("key", "c"), ["key", "c"]).select("place", "lo", "hi"))
    del cutup
    tmp.drop("cutup")
    split = tmp.table("split", classes.groupBy("key").agg(F.count("*").alias("n_classes"), F.max(F.expr("n = 1 and open")).alias("unsure")).filter("n_classes > 1 and unsure").select("key"))
    ones = classes.join(split, "key", "left_semi").select("m.place", "m.lo", "m.hi", F.expr("n = 1 and open").alias("open"))

    # 4. Window by window.
    of_anchor = spread.select("place", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    owned = ones.join(of_anchor, "place").filter("lo >= a_lo and hi <= a_hi").groupBy("place", "a_lo").agg(F.collect_list(F.struct("lo", "hi", "open")).alias("wanted")).withColumnRenamed("a_lo", "lo")
    single = tmp.table("single", spread.select("place", "lo", "data").join(owned, ["place", "lo"]).mapInPandas(windows, "place long, lo int, open boolean, w1 long, w2 long"))
    del spread, classes, split, ones, of_anchor, owned
    tmp.drop("spread", "classes", "split")
    twice = tmp.table("twice", single.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2"))
    last = single.filter("open").join(twice, ["w1", "w2"]).select("place", "lo", F.col("lo").alias("hi"))
    return repeated.unionByName(same).unionByName(last)


def covered(ranges: list, length: int) -> list[tuple[int, int]]:
    """Longest runs of bytes inside the windows that start in the ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, z) for a, z in out]


def remove_repeats(docs: DataFrame, p: RepeatParams = RepeatParams(), text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes, the removed ``spans`` (bytes) and the ``kept`` bytes."""
    inside, back, names = hidden(docs, "n_bytes", "spans", "kept")
    placed = with_place(inside, "place")
    bounded_batches(docs.sparkSession)
    tmp = Scratch(docs.sparkSession)
    ranges = find_repeats(placed.select("place", F.col(names[text_col]).alias("text")), tmp, p)
    found = tmp.table("found", ranges.groupBy("place").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))
    del ranges
    tmp.drop("repeated", "same", "single", "twice")

    @F.pandas_udf(RESULT)
    def remove(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = []
        for text, r in zip(texts, ranges):
            data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
            spans = covered([(x["lo"], x["hi"]) for x in r], p.length) if r is not None else []
            edges = [0, *[e for s in spans for e in s], len(data)]
            rows.append((len(data), [{"start": a, "end": z} for a, z in spans], b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2]))))
        return pd.DataFrame(rows, columns=["n_bytes", "spans", "kept"])

    out = placed.join(found, "place", "left").withColumn("r", remove(F.col(names[text_col]), F.col("ranges")))
    return out.select(*back, "r.*")
