"""URL filters: a Bloom filter cascade over listed keys.

A listed key is a host with a path prefix, like ``example.net/de/8`` or ``casino-win.example.com/``.
Level 0 of the cascade holds the listed keys, level 1 those keys of the corpus that level 0 takes for
listed by mistake, level 2 the listed keys that level 1 takes for mistakes, and so on until a level
makes no mistake.  As the levels were built over every key that the corpus can ask for (the key
universe), the answer for each of them is exact, and no join is needed to look one up.

The filters are built by Spark: keys are hashed by ``xxhash64`` in the JVM, bits are or-ed per 64-bit
word.  Level 0 has the more bits for each listed key the larger the universe is against the list, so that its
mistakes are no more than the listed keys: every level grows with the list, and level 0 besides with the
logarithm of the universe.  What is sent to the executors is bounded by ``max_filter_bytes``; a longer list
of keys takes a shuffled semi join instead, with the same result.

Defined results: a url that is null or has no ``://`` has an empty host and path and is allowed; ties
between rules of equal length go to the longer host; repeated rows are judged row by row; an empty
table gives an empty result; columns of the input named like a result column are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, hidden, with_place


@dataclass(frozen=True)
class Rule:
    verdict: str  # block or allow
    host: str
    path: str = "/"

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class CascadeParams:
    #: Share of other keys that may pass a level; level 0 lets pass no more than the list has keys.
    mistakes: float = 0.01
    max_filter_bytes: int = 32 << 20
    max_levels: int = 40


@dataclass(frozen=True)
class Cascade:
    """Levels of (bits, seed, hash functions); an even level speaks for the list, an odd one against it."""

    levels: tuple[tuple[np.ndarray, int, int], ...]

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed: the first level that does not hold a key decides."""
        out, left = np.full(len(h1), len(self.levels) % 2 == 1), np.ones(len(h1), bool)
        for i, (bits, seed, hashes) in enumerate(self.levels):
            held = left.copy()
            for k in range(hashes):
                p = _position(h1, h2, k, seed, len(bits) * 64)
                held &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
            out[left & ~held] = i % 2 == 1
            left = held
        return out


def _position(h1: np.ndarray, h2: np.ndarray, k: int, seed: int, m: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1.astype(np.uint64) + np.uint64(k + 64 * seed) * (h2.astype(np.uint64) | np.uint64(1))
        x ^= x >> np.uint64(29)
        return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)) % np.uint64(m)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.reverse(key), F.lit(1)).alias("h2")]


def _level(keys: DataFrame, bits_in_all: int, seed: int, hashes: int) -> np.ndarray:
    """The filter of ``keys`` (h1, h2); each task sets its keys' bits, Spark ors them word by word."""
    words = max(1, -(-bits_in_all // 64))

    def set_bits(batches):
        bits = np.zeros(words, np.uint64)
        for b in batches:
            for k in range(hashes):
                p = _position(b["h1"].to_numpy(), b["h2"].to_numpy(), k, seed, words * 64)
                np.bitwise_or.at(bits, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pd.DataFrame({"word": at, "bits": bits[at].view(np.int64)})

    out = np.zeros(words, np.uint64)
    rows = keys.mapInPandas(set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def build_cascade(listed: DataFrame, universe: DataFrame, params: CascadeParams = CascadeParams()) -> Cascade | None:
    """``listed`` and ``universe`` have a column ``key``.  None if the list is longer than the bound allows."""
    marked = listed.select("key", F.lit(1).alias("own")).unionByName(universe.select("key", F.lit(0).alias("own"))).filter("key is not null")
    keys = cut(marked.groupBy("key").agg(F.max("own").alias("own")).select("own", *_hashes(F.col("key"))))
    sides, levels = {1: keys.filter("own = 1"), 0: keys.filter("own = 0")}, []
    for i in range(params.max_levels):
        side = (i + 1) % 2
        n = sides[side].count()
        if n == 0:
            return Cascade(tuple(levels))
        mistakes = params.mistakes if i else min(params.mistakes, n / max(1, sides[0].count()))
        size = math.ceil(n * math.log2(1 / mistakes) / math.log(2))
        if size > 8 * params.max_filter_bytes:
            return None
        hashes = max(1, round(math.log2(1 / mistakes)))
        levels.append((_level(sides[side], size, i, hashes), i, hashes))
        # What the other side has left are the keys that this level holds by mistake.
        sides[1 - side] = sides[1 - side].filter(_held(levels[-1])(F.col("h1"), F.col("h2")))
    return None


def _held(level: tuple[np.ndarray, int, int]):
    one = Cascade((level,))

    @F.pandas_udf("boolean")
    def held(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(one.contains(h1.to_numpy(), h2.to_numpy()))

    return held


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Keys that could fit: every suffix of the host at a dot, with the path's prefixes of the listed lengths; longest first."""
    labels = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in sorted(path_lengths, reverse=True)]), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.struct((-(F.length(s) + n)).alias("o"), (-F.length(s)).alias("h"), F.concat(s, F.substring(path, F.lit(1), n)).alias("key")))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(pairs), lambda p: p["key"]))


def _first_listed(df: DataFrame, keys: str, cascade: Cascade | None, listed: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: the first of the array column ``keys`` that is listed."""
    if cascade is None:  # a list beyond the bound: the same by a shuffled semi join
        hits = df.select("_place", F.posexplode(keys).alias("_i", "key")).join(listed.select("key").hint("shuffle_hash"), "key", "left_semi")
        first = hits.groupBy("_place").agg(F.min_by("key", "_i").alias(out))
        return df.join(first, "_place", "left")

    @F.pandas_udf("int")
    def first(h1: pd.Series, h2: pd.Series) -> pd.Series:
        sizes = h1.map(len).to_numpy()
        flat = [np.concatenate([np.asarray(x, np.int64) for x in h]) if sizes.sum() else np.zeros(0, np.int64) for h in (h1, h2)]
        found, ends = np.append(np.flatnonzero(cascade.contains(*flat)), sizes.sum()), np.cumsum(sizes)
        starts = ends - sizes
        at = found[np.searchsorted(found, starts)]
        return pd.Series(np.where(at < ends, at - starts + 1, 0).astype(np.int32))

    h1, h2 = F.transform(keys, lambda k: _hashes(k)[0]), F.transform(keys, lambda k: _hashes(k)[1])
    at = df.withColumn("_at", first(h1, h2))
    return at.withColumn(out, F.when(F.col("_at") > 0, F.try_element_at(keys, F.col("_at")))).drop("_at")


def filter_urls(pages: DataFrame, rules: list[Rule], blocked: DataFrame | list[str], params: CascadeParams = CascadeParams(), url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules`` decide first, the longest that fits.  A url that none fits is blocked if its host or a
    parent of it is one of the ``blocked`` hosts, else allowed.
    """
    spark = pages.sparkSession
    hosts = spark.createDataFrame([(h + "/",) for h in blocked], "key string") if isinstance(blocked, list) else blocked.select(F.concat(F.col(blocked.columns[0]), F.lit("/")).alias("key"))
    of_rules = spark.createDataFrame([(r.key, r.verdict) for r in rules], "key string, verdict string")
    inside, kept, names = hidden(pages, "host", "path", "rule", "verdict")
    host, path = url_parts(F.col(names[url_col]).cast("string"))
    base = with_place(inside).withColumns({"host": host, "path": path})
    # A blocked host counts as "host/", whatever the path.
    asked = base.withColumns({"_r": candidate_keys(F.col("host"), F.col("path"), sorted({len(r.path) for r in rules} or {1})), "_h": candidate_keys(F.col("host"), F.lit("/"), [1])})
    by_rule = build_cascade(of_rules, asked.select(F.explode("_r").alias("key")), params)
    # Which listed rules block: a cascade whose universe is the list itself.
    to_block = build_cascade(of_rules.filter("verdict = 'block'"), of_rules, params)
    by_host = build_cascade(hosts, asked.select(F.explode("_h").alias("key")), params)
    out = _first_listed(asked, "_r", by_rule, of_rules, "rule")
    out = _first_listed(out, "_h", by_host, hosts, "_blocked")
    out = _first_listed(out.withColumn("_b", F.when(F.col("rule").isNull(), F.array().cast("array<string>")).otherwise(F.array("rule"))), "_b", to_block, of_rules.filter("verdict = 'block'"), "_block")
    blocks = F.when(F.col("rule").isNotNull(), F.col("_block").isNotNull()).otherwise(F.col("_blocked").isNotNull())
    return out.withColumn("verdict", F.when(blocks, "block").otherwise("allow")).select(*kept, "host", "path", "rule", "verdict")
