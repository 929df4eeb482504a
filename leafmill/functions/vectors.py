"""Vectors of names, and an index over vectors: cells around centroids, searched nearest first and ranked exactly."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.plan import once
from leafmill.functions.similarity import COSINE_THRESHOLD, cosine


def with_embedding(df: DataFrame, text: Column, name: str = "embedding", dim: int = 128, n: int = 3) -> DataFrame:
    """``df`` with a vector of the text's character n-grams by feature hashing.

    The lower-case text between two marks is cut into its n-grams; each adds 1 or -1, by its digest, at one of ``dim``
    places.  A null or blank text has no vector.
    """
    low = F.concat(F.lit("^"), F.lower(F.trim(text)), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length("_e") - (n - 1)), lambda i: F.substring("_e", i, F.lit(n)))
    number = lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("long")
    marked = once(df, {"_e": F.when(F.trim(text) != "", low)})
    hashed = once(marked, {"_h": F.when(F.length("_e") >= n, F.transform(grams, number))})
    add = lambda d: F.aggregate("_h", F.lit(0), lambda s, h: s + F.when(h % dim == d, F.when(F.floor(h / dim) % 2 == 0, 1).otherwise(-1)).otherwise(0))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: add(d).cast("double"))
    return hashed.withColumn(name, F.when(F.col("_h").isNotNull(), vector)).drop("_e", "_h")


@dataclass(frozen=True)
class IndexParams:
    cells: int = 64
    #: Vectors that the centroids are fitted on, by the smallest hashes of their ids; all vectors are indexed.
    max_fitted: int = 20_000
    #: Nearest cells that a query searches.
    probes: int = 8
    rounds: int = 10
    seed: int = 42


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def fit_centroids(vectors: DataFrame, params: IndexParams = IndexParams()) -> np.ndarray:
    """Unit centroids of cells: spherical k-means over a bounded part of the vectors."""
    few = vectors.filter("embedding is not null").orderBy(F.xxhash64(F.lit(params.seed), "vendor_id")).limit(params.max_fitted)
    rows = [r[0] for r in few.select("embedding").collect()]
    if not rows:
        return np.zeros((0, 0))
    m = _unit(np.array(rows, float))
    rng = np.random.default_rng(params.seed)
    centroids = m[rng.permutation(len(m))[: params.cells]]
    for _ in range(params.rounds):
        own = (m @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, m)
        held = np.bincount(own, minlength=len(centroids)) > 0
        centroids = np.where(held[:, None], _unit(sums), centroids)
    return centroids


def nearest_cells(embedding: Column, centroids: np.ndarray, n: int) -> Column:
    """Numbers of the ``n`` cells nearest to a vector, nearest first."""

    @F.pandas_udf("array<int>")
    def near(vectors: pd.Series) -> pd.Series:
        if not len(centroids):
            return pd.Series([[0]] * len(vectors), dtype=object)  # one cell for all
        m = _unit(np.array(vectors.tolist(), float).reshape(len(vectors), -1))
        return pd.Series(np.argsort(-(m @ centroids.T), axis=1, kind="stable")[:, :n].astype(np.int32).tolist(), dtype=object)

    return near(embedding)


def indexed_vectors(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors`` (workspace_id, vendor_id, embedding) with their ``cell``; written partitioned by it, a search reads only its cells."""
    return vectors.filter("embedding is not null").withColumn("cell", F.explode(nearest_cells(F.col("embedding"), centroids, 1)))


def indexed_top1(queries: DataFrame, index: DataFrame, centroids: np.ndarray, threshold: float = COSINE_THRESHOLD, probes: int | None = IndexParams.probes, but_itself: bool = False) -> DataFrame:
    """Nearest vector of the same workspace for each query (workspace_id, query_id, embedding), if its cosine reaches ``threshold``.

    A query searches its ``probes`` nearest cells and ranks what they hold exactly; ``None`` searches all cells,
    which is exact.  Of equal cosines the smallest id wins.  Spark splits a large cell's vectors in the join, and the
    best of each part is found before the parts are united.
    """
    asked = queries.filter("embedding is not null").select("workspace_id", "query_id", F.col("embedding").alias("q"))
    n = max(1, len(centroids) if probes is None else min(probes, len(centroids)))
    asked = asked.withColumn("cell", F.explode(nearest_cells(F.col("q"), centroids, n)))
    held = index.select("workspace_id", "cell", "vendor_id", F.col("embedding").alias("v"))
    scored = asked.join(held, ["workspace_id", "cell"]).select("workspace_id", "query_id", "vendor_id", cosine(F.col("q"), F.col("v")).alias("score"))
    if but_itself:
        scored = scored.filter("query_id <> vendor_id")
    best = scored.filter("score is not null").groupBy("workspace_id", "query_id").agg(F.min(F.struct((-F.col("score")).alias("o"), "vendor_id", "score")).alias("b"))
    return best.select("workspace_id", "query_id", "b.vendor_id", "b.score").filter(F.col("score") >= threshold)
