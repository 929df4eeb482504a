"""Benchmark decontamination with suffix arrays of the training text.

Each batch of documents is a shard: its words become numbers (zero: not a word of the benchmark) and its
suffixes are sorted into a suffix array.  Suffixes that start with a word pair no benchmark item has
cannot match and stay out of the array.  Every benchmark suffix is binary-searched in every shard's
array; neighbouring hits on one diagonal join into longest verbatim matches with their locations, and
documents with too large a part inside matches are removed.

The benchmark travels to the shards in blocks of at most ``block_words`` words; a larger one takes
several passes whose matches are united.

Defined results: a null or empty text has no words and is never contaminated; a benchmark item without
words matches nothing; items with one id count once, a null id counts as the empty string; repeated rows
are judged row by row; empty tables give an empty result or no matches; columns of the input named like
a result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import bounded_batches, cut, hidden, lower_ascii, with_place

#: Letters a-z, digits and everything beyond ASCII, after A-Z are lower-cased.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
MATCH = "struct<item_id:string,start:long,item_start:long,n_words:long>"
FOUND = f"struct<n_words:long,n_hit:long,item_ids:array<string>,matches:array<{MATCH}>>"


@dataclass(frozen=True)
class DecontamParams:
    window: int = 13
    #: Contaminated from n_hit / n_words >= 1 / part on.
    part: int = 20
    block_words: int = 2_000_000
    shard_words: int = 4_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lower_ascii(text)) if isinstance(text, str) else []


class TestSuffixes:
    """The suffixes of a block of items that start a window, ready to be searched."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.window, self.ids = window, [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        number = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] for _, words in items]
        self.item, self.offset, self.length, rows = [], [], [], []
        for k, ids in enumerate(number):
            n = min(window, len(ids))
            for at in range(len(ids) - n + 1 if n else 0):
                self.item.append(k)
                self.offset.append(at)
                self.length.append(n)
                rows.append(ids[at : at + n] + [0] * (window - n))
        self.item, self.offset, self.length = (np.array(x, np.int64) for x in (self.item, self.offset, self.length))
        self.rows = np.array(rows, np.uint32).reshape(-1, window)
        self.pairs_matter = bool(len(rows)) and int(self.length.min()) >= 2
        self.first = np.unique(self._start(self.rows[:, 0], self.rows[:, 1] if window > 1 else self.rows[:, 0]))

    def _start(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) * (len(self.vocabulary) + 1) + b if self.pairs_matter else a.astype(np.int64)

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, suffix number) of every window's every occurrence, through a suffix array of ``text``."""
        none = np.zeros(0, np.int64)
        if not len(self.rows) or not len(text):
            return none, none
        padded = np.concatenate([text, np.zeros(self.window, np.uint32)])
        start = self._start(text, padded[1 : len(text) + 1])
        places = np.flatnonzero(text)
        at = np.searchsorted(self.first, start[places])
        places = places[self.first[np.minimum(at, len(self.first) - 1)] == start[places]]
        if not len(places):
            return none, none
        width = 4 * self.window
        suffixes = np.ascontiguousarray(padded[places[:, None] + np.arange(self.window)].astype(">u4")).view(f"S{width}").ravel()
        order = np.argsort(suffixes, kind="stable")
        array, places = suffixes[order], places[order]
        low = self.rows.astype(">u4")
        high = np.where(np.arange(self.window) < self.length[:, None], self.rows, 0xFFFFFFFF).astype(">u4")
        begin = np.searchsorted(array, np.ascontiguousarray(low).view(f"S{width}").ravel(), "left")
        end = np.searchsorted(array, np.ascontiguousarray(high).view(f"S{width}").ravel(), "right")
        count = np.maximum(end - begin, 0)
        which = np.repeat(np.arange(len(count)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return places[np.repeat(begin, count) + inside], which

    def search(self, docs: list[str | None]) -> list[tuple]:
        """For each text: words, words inside matches, item ids and longest matches."""
        get = self.vocabulary.get
        parts, sizes = [], []
        for text in docs:
            words = words_of(text)
            sizes.append(len(words))
            parts.append(np.fromiter((get(w, 0) for w in words), np.uint32, len(words)))
            parts.append(np.zeros(1, np.uint32))  # no match goes on into the next text
        sizes = np.array(sizes, np.int64)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        place, which = self.occurrences(np.concatenate(parts)) if parts else (np.zeros(0, np.int64),) * 2
        edge = np.zeros(int((sizes + 1).sum()) + self.window + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + self.length[which], -1)
        hits = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
        n_hit = hits[starts + sizes] - hits[starts]
        out = [(int(n), int(h), [], []) for n, h in zip(sizes, n_hit)]
        if len(place):
            item, offset, length = self.item[which], self.offset[which], self.length[which]
            order = np.lexsort((place, place - offset, item))
            place, item, offset, length = place[order], item[order], offset[order], length[order]
            fresh = np.ones(len(place), bool)
            fresh[1:] = (item[1:] != item[:-1]) | (place[1:] - offset[1:] != place[:-1] - offset[:-1]) | (place[1:] != place[:-1] + 1)
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(place)) - 1
            doc = np.searchsorted(starts, place[first], "right") - 1
            for d, f, z in zip(doc.tolist(), first.tolist(), last.tolist()):
                out[d][3].append((self.ids[item[f]], int(place[f] - starts[d]), int(offset[f]), int(place[z] - place[f] + length[z])))
        return [(n, h, sorted({m[0] for m in ms}), ms) for n, h, _, ms in out]


def _shards(texts, words: int) -> Iterator[list]:
    """Texts in lists of about ``words`` words, taken as six characters each."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t) if isinstance(t, str) else 0
        if n >= 6 * words:
            yield out
            out, n = [], 0
    if out:
        yield out


def benchmark_blocks(benchmark: DataFrame, params: DecontamParams, id_col: str = "item_id", text_col: str = "text") -> Iterator[TestSuffixes]:
    """The benchmark in blocks of bounded size, one at a time on the driver."""
    block, n = [], 0
    for row in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = words_of(row["t"])
        block.append((row["i"], words))
        n += len(words)
        if n >= params.block_words:
            yield TestSuffixes(block, params.window)
            block, n = [], 0
    yield TestSuffixes(block, params.window)


def _searcher(block: TestSuffixes, params: DecontamParams):
    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = [r for shard in _shards(texts, params.shard_words) for r in block.search(shard)]
        names = ["item_id", "start", "item_start", "n_words"]
        return pd.DataFrame([(n, h, ids, [dict(zip(names, m)) for m in ms]) for n, h, ids, ms in rows], columns=["n_words", "n_hit", "item_ids", "matches"])

    return found


def _covered(matches: Column) -> Column:
    """Words inside any of the matches."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["n_words"]).alias("z"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("z"))
    return F.aggregate(spans, start, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["z"] - F.greatest(s["z"], x["a"]))).alias("n"), F.greatest(s["z"], x["z"]).alias("z")), lambda s: s["n"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, params: DecontamParams = DecontamParams(), text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids, matches and contaminated."""
    bounded_batches(docs.sparkSession)
    blocks = benchmark_blocks(benchmark, params)
    first, second = next(blocks), next(blocks, None)
    results = ("n_words", "n_hit", "item_ids", "matches", "contaminated")
    inside, back, names = hidden(docs, *results)
    if second is None:
        out = inside.withColumn("_f", _searcher(first, params)(F.col(names[text_col]))).select(*back, "_f.*")
    else:
        placed, parts = with_place(inside), []
        for block in _chain(first, second, blocks):
            parts.append(cut(placed.select("_place", _searcher(block, params)(F.col(names[text_col])).alias("_f")).select("_place", "_f.n_words", "_f.matches")))
        united = parts[0]
        for p in parts[1:]:
            united = united.unionByName(p)
        merged = united.groupBy("_place").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))
        merged = merged.select("_place", "n_words", _covered(F.col("matches")).alias("n_hit"), F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"]))).alias("item_ids"), "matches")
        out = placed.join(merged, "_place").select(*back, "n_words", "n_hit", "item_ids", "matches")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (params.part * F.col("n_hit") >= F.col("n_words")))


def _chain(*parts):
    for p in parts:
        yield from [p] if isinstance(p, TestSuffixes) else p


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: DecontamParams = DecontamParams()) -> DataFrame:
    """``docs`` without contaminated documents, with their own columns only."""
    found = find_contamination(docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text")), benchmark, params, "_text")
    return found.filter(~F.col("contaminated")).select("_row.*")
