"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are tokens as they stand,
a whole batch's distinct pre-tokens at a time.  Tier two, for the misses: the bytes become a doubly
linked list, a heap holds the adjacent pairs by rank (ties: leftmost first), and the best pair is merged
until none has a rank.  Ids equal those of the tiktoken library.

The vocabulary is a bounded table (its size is its own bound) and travels with the tasks.

Defined results: a null or empty text has no tokens; repeated rows are encoded row by row; an empty
table gives an empty result; columns of the input named like a result column are replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import bounded_batches


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list = [None] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def _hash(keys: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each byte string, column by column over strings of like length."""
    out, lengths = np.zeros(len(keys), np.uint64), np.fromiter(map(len, keys), np.int64, len(keys))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    with np.errstate(over="ignore"):
        for rows in np.split(order, cuts) if len(keys) else []:
            n = int(lengths[rows[0]])
            raw = np.frombuffer(b"".join([keys[i] for i in rows]), np.uint8).reshape(len(rows), n)
            h = np.full(len(rows), (n * _M1) & _MASK, np.uint64)
            for j in range(n):
                h = (h ^ raw[:, j]) * np.uint64(_M2)
                h ^= h >> np.uint64(31)
            out[rows] = h * np.uint64(_M1)
    return out


def _slot(h: np.ndarray, seed: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ (seed.astype(np.uint64) * np.uint64(_M1))) * np.uint64(_M2)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys take exactly the slots 0 to n - 1."""

    def __init__(self, keys: list[bytes], values: list[int], per_bucket: int = 4):
        n = len(keys)
        self.size, self.buckets = n, max(1, n // per_bucket)
        self.seeds = np.zeros(self.buckets, np.uint32)
        h = _hash(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if n else []
        taken = np.zeros(n, bool)
        for rows in sorted(groups, key=len, reverse=True):
            hs = h[rows]
            for start in range(1, 1 << 31, 64):
                # 64 displacements at a time; the first that puts all rows on free slots of their own.
                seeds = np.arange(start, start + 64, dtype=np.uint64)
                at = _slot(hs[None, :], seeds[:, None], n)
                free = ~taken[at].any(axis=1)
                if len(rows) > 1:
                    s = np.sort(at, axis=1)
                    free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if free.any():
                    k = int(np.argmax(free))
                    self.seeds[bucket[rows[0]]] = seeds[k]
                    taken[at[k]] = True
                    break
        slot = _slot(h, self.seeds[bucket], n) if n else np.zeros(0, np.int64)
        self.keys: list = [None] * n
        self.values = np.zeros(n, np.int64)
        for i, s in enumerate(slot.tolist()):
            self.keys[s] = keys[i]
        self.values[slot] = values

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """The value of each key, -1 if it has none."""
        if not keys or not self.size:
            return np.full(len(keys), -1, np.int64)
        h = _hash(keys)
        slot = _slot(h, self.seeds[(h % np.uint64(self.buckets)).astype(np.int64)], self.size)
        own = self.keys
        same = np.fromiter((own[s] == k for s, k in zip(slot.tolist(), keys)), bool, len(keys))
        return np.where(same, self.values[slot], -1)


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of a pre-token by merging its bytes, lowest rank first, leftmost among equals."""
    n = len(piece)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if end[i] else n
        if j >= n or end[i] == 0 or end[j] != stop:  # one of the two was merged meanwhile
            continue
        end[i], end[j], nxt[i] = stop, 0, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
            if (r := ranks.get(piece[i : end[nxt[j]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[j]]))
        if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : stop])) is not None:
            heapq.heappush(heap, (r, prev[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


def _chunks(texts, size: int = 1 << 19) -> Iterator[list]:
    """Texts in lists of about ``size`` characters; a longer text is a list of its own."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t) if isinstance(t, str) else 0
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


#: Built lookups by the digest of their vocabulary: a Python worker keeps them for all its tasks.
_BUILT: dict[bytes, tuple] = {}


@dataclass
class Vocabulary:
    """Token bytes by id, and the pattern that cuts a text into pre-tokens."""

    tokens: list[bytes]
    pattern: str
    #: Pre-tokens of which a worker remembers the tokens, in each of two generations, and the characters of the longest.
    remembered: int = 130_000
    longest: int = 64

    def __post_init__(self) -> None:
        parts = sha256(self.pattern.encode())
        for t in self.tokens:
            parts.update(b"-" if t is None else pack("<I", len(t)) + t)
        self.digest = parts.digest()

    def ready(self) -> tuple:
        """Built once in each Python worker, as all its tasks unpickle vocabularies of one digest."""
        if self.digest not in _BUILT:
            ids = [i for i, t in enumerate(self.tokens) if t is not None]
            keys = [self.tokens[i] for i in ids]
            _BUILT[self.digest] = PerfectHash(keys, ids), dict(zip(keys, ids)), regex.compile(self.pattern), {"young": {}, "old": {}}
        return _BUILT[self.digest]

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """Tokens of each text, packed as little-endian unsigned 32-bit integers."""
        perfect, ranks, pattern, memo = self.ready()
        for some in _chunks(texts):
            cut = [pattern.findall(t) if isinstance(t, str) else [] for t in some]
            known, older, new = memo["young"], memo["old"], []
            for p in {}.fromkeys(chain.from_iterable(cut)):
                if p not in known:
                    if p in older:
                        known[p] = older[p]
                    else:
                        new.append(p)
            raw = [p.encode() for p in new]
            for p, b, i in zip(new, raw, perfect.lookup(raw).tolist()):
                ids = (i,) if i >= 0 else merge_bytes(b, ranks)
                known[p] = pack(f"<{len(ids)}I", *ids)
            get = known.__getitem__
            packed = [b"".join(map(get, pieces)) for pieces in cut]
            # Bounds the memory: long pre-tokens are forgotten at once, others when not used again.
            for p in new:
                if len(p) > self.longest:
                    del known[p]
            if len(known) > self.remembered:
                memo["young"], memo["old"] = {}, known
            yield from packed

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` with ``tokens``, the ids of each text packed as little-endian unsigned 32-bit integers."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(list(vocabulary.encode_batch(texts)), dtype=object)

    # Nondeterministic for the optimizer only: else it would encode again for every use of the tokens.
    return docs.withColumn("tokens", tokens.asNondeterministic()(F.col(text_col)))


def unpack(tokens: Column) -> Column:
    """array<long> of packed ids."""
    digits = F.hex(tokens)
    pair = lambda i, k: F.substring(digits, 8 * i + 2 * k + 1, F.lit(2))
    one = lambda i: F.conv(F.concat(*[pair(i, k) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    count = (F.octet_length(tokens) / 4).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<long>"))


def decode(df: DataFrame, vocabulary: Vocabulary, tokens_col: str = "tokens") -> DataFrame:
    """``df`` with ``bytes``, what the tokens stand for."""

    @F.pandas_udf("binary")
    def back(tokens: pd.Series) -> pd.Series:
        return pd.Series([vocabulary.decode(x or b"") for x in tokens], dtype=object)

    return df.withColumn("bytes", back(F.col(tokens_col)))


def digests(tokens_col: str = "tokens", bytes_col: str = "bytes") -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256."""
    return [(F.octet_length(tokens_col) / 4).cast("long").alias("n_tokens"), F.sha2(F.col(tokens_col), 256).alias("ids_sha256"), F.sha2(F.col(bytes_col), 256).alias("decoded_sha256")]
