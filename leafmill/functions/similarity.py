"""Similarities of names and of vectors, and joins on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.plan import cut

FUZZY_THRESHOLD = 90.0
COSINE_THRESHOLD = 0.85
#: Names are first looked for at this score.
CLOSE = 97.0


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        x = row & masks.get(c, 0)
        row = ((row + x) | (row - x)) & full
    return len(a) - row.bit_count()


def token_sort_score(a: str | None, b: str | None) -> float:
    """100 times the normalized insert-delete similarity of the names with their words sorted."""
    if a is None or b is None:
        return 0.0
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * _lcs(a, b) / total


def token_sort_ratio(left: Column, right: Column) -> Column:
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_sort_score(x, y) for x, y in zip(a, b)], dtype=float)

    return score(left, right)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


#: White space as Python's ``split`` knows it.
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _sorted_words(name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(name, _SPACE), lambda w: w != "")), " ")


def _measured(names: DataFrame, name: str, threshold: float) -> DataFrame:
    """Distinct (workspace_id, ``name``) with its sorted words' length ``n``, distinct pairs of neighbouring
    characters, and how many of these a name of a sufficient score may lack (``lack``)."""
    ratio = threshold / (200.0 - threshold)
    words = _sorted_words(F.col(name))
    n = F.length("_s")
    grams = F.when(n > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring("_s", i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
    # Insertions and deletions make up this share of both lengths at most, and each of them spoils two pairs at most.
    lack = 2 * F.floor((1 - threshold / 100) * n * (1 + 1 / ratio) + 1e-9)
    return names.select("workspace_id", name).filter(F.col(name).isNotNull()).distinct().withColumn("_s", words).select("workspace_id", name, n.alias("n"), grams.alias("grams"), lack.cast("int").alias("lack"))


def similar_names(left: DataFrame, right: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(workspace_id, name, other, score) for all names of ``left`` and others of ``right`` (workspace_id, other)
    whose score reaches ``threshold``.

    Names of such a score share all but a few pairs of neighbouring characters, so they share one among
    their rarest few of the tenant, by which they meet, if their lengths allow the score: nothing is lost.  Names too short or too uniform for that meet
    the others by length band.  Of those that meet, only names that share enough pairs of characters are scored.
    """
    ratio = threshold / (200.0 - threshold)
    a, b = _measured(left, "name", threshold), _measured(right, "other", threshold)
    place = ["workspace_id", "gram"]
    each = lambda df: df.select("workspace_id", F.explode("grams").alias("gram"))
    held = each(a).union(each(b)).groupBy(*place).agg(F.count("*").alias("held"))

    def rarest(df: DataFrame, name: str, size: str) -> DataFrame:
        spread = df.select("workspace_id", name, "n", "lack", F.explode("grams").alias("gram")).join(held, place)
        few = F.slice(F.array_sort(F.collect_list(F.struct("held", "gram"))), F.lit(1), F.first("lack") + 1)
        return spread.groupBy("workspace_id", name, "n").agg(few.alias("few")).select("workspace_id", name, "n", F.explode("few.gram").alias("gram")).withColumn(size, F.col("n"))

    def sized(df: DataFrame, name: str, size: str) -> DataFrame:
        return df.select("workspace_id", name, F.col("n").alias(size), F.col("grams").alias(f"{name}_grams"), F.col("lack").alias(f"{name}_lack"))

    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.log(F.lit(1 / ratio))).cast("int")
    near = lambda df: df.withColumn("band", F.explode(F.array(*[band + d for d in (-1, 0, 1)])))
    odd = F.size("grams") <= F.col("lack")
    names = ["workspace_id", "name", "other"]
    fits = F.least("_n", "_m") >= ratio * F.greatest("_n", "_m")
    met = near(rarest(a, "name", "_n")).drop("n").join(rarest(b, "other", "_m").withColumn("band", band).drop("n"), [*place, "band"]).filter(fits).select(*names)
    for x, y in ((a.filter(odd), b), (a, b.filter(odd))):
        others = y.withColumn("band", band).select("workspace_id", "other", "band")
        met = met.union(near(x).join(others, ["workspace_id", "band"]).select(*names))
    pairs = met.distinct().join(sized(a, "name", "n"), ["workspace_id", "name"]).join(sized(b, "other", "m"), ["workspace_id", "other"])
    shared = F.size(F.array_intersect("name_grams", "other_grams"))
    enough = shared >= F.greatest(F.size("name_grams") - F.col("name_lack"), F.size("other_grams") - F.col("other_lack"))
    pairs = pairs.filter((F.least("n", "m") >= ratio * F.greatest("n", "m")) & enough).select(*names)
    return pairs.withColumn("score", token_sort_ratio(F.col("name"), F.col("other"))).filter(F.col("score") >= threshold)


def fuzzy_matches(names: DataFrame, candidates: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Best candidate of each (workspace_id, name): columns vendor_id, matched and score.

    ``candidates``: workspace_id, vendor_id, display, position (of any type with an order).  Of equal scores
    the candidate with the first position wins; of one display the vendor with the last.
    """
    first = candidates.groupBy("workspace_id", F.col("display").alias("other")).agg(F.min("position").alias("at"), F.max_by("vendor_id", "position").alias("vendor_id"))
    key = ["workspace_id", "name"]
    best = F.min_by(F.struct("vendor_id", F.col("other").alias("matched"), "score"), F.struct(-F.col("score"), "at"))
    top = lambda scored: scored.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")
    rest = names.select(*key).filter((F.regexp_replace("name", _SPACE, "") != "") & F.col("workspace_id").isNotNull()).distinct()
    same = rest.withColumn("_s", _sorted_words(F.col("name"))).join(first.withColumn("_s", _sorted_words(F.col("other"))), ["workspace_id", "_s"])
    found = cut(top(same.withColumn("score", F.lit(100.0)))) if threshold <= 100 else None
    # What a name reaches at a high threshold no name below it surpasses, and there the rarest pairs are few and telling.
    for step in [t for t in (CLOSE,) if t > threshold] + [threshold]:
        left = rest if found is None else rest.join(found.select(*key), key, "left_anti")
        more = top(similar_names(left, first.select("workspace_id", "other"), step).join(first, ["workspace_id", "other"]))
        found = more if found is None else found.unionByName(more)
        found = cut(found) if step > threshold else found
    return found


def _matrices(ids: pd.Series, vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of the vectors: their ids, the vectors as rows, and their norms; rows without a length go."""
    out = {}
    sizes = vectors.map(len).to_numpy()
    for size in np.unique(sizes[sizes > 0]):
        here = sizes == size
        m = np.array(vectors[here].tolist(), float)
        norms = np.sqrt(_dots(m, m))
        fit = norms > 0
        out[int(size)] = (ids.to_numpy()[here][fit], m[fit], norms[fit])
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows, summed from left to right, so that equal rows have equal products wherever they lie."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


#: What the sum of a matrix product may differ by from one from left to right.
_SLACK = 1e-9


class _Nearest:
    """The best vector so far of each of a block's queries; vectors pass by in batches."""

    def __init__(self, ids: pd.Series, vectors: pd.Series, but_itself: bool):
        self.but_itself, self.asked = but_itself, _matrices(ids, vectors)
        self.floor = {size: np.full(len(q), -np.inf) for size, (q, _, _) in self.asked.items()}
        self.best = {size: pd.DataFrame({"i": [], "score": [], "vendor_id": []}) for size in self.asked}

    def add(self, ids: pd.Series, vectors: pd.Series, each: int = 512) -> None:
        for size, (v_ids, v, v_norms) in _matrices(ids, vectors).items():
            for at in range(0, len(v) if size in self.asked else 0, each):
                self._add(size, v_ids[at : at + each], v[at : at + each], v_norms[at : at + each])

    def _add(self, size: int, v_ids: np.ndarray, v: np.ndarray, v_norms: np.ndarray) -> None:
        q_ids, q, q_norms = self.asked[size]
        if not len(q):
            return
        near = (q / q_norms[:, None]) @ (v / v_norms[:, None]).T
        if self.but_itself:
            near[q_ids[:, None] == v_ids[None, :]] = -np.inf
        floor = np.maximum(self.floor[size], near.max(axis=1))
        i, j = np.nonzero((near >= floor[:, None] - _SLACK) & (near > -np.inf))
        # Those that the product cannot tell from the best are ranked by their own sums.
        score = _dots(q[i], v[j]) / (q_norms[i] * v_norms[j])
        both = pd.concat([self.best[size], pd.DataFrame({"i": i, "score": score, "vendor_id": v_ids[j]})]) if len(self.best[size]) else pd.DataFrame({"i": i, "score": score, "vendor_id": v_ids[j]})
        # Vectors pass by in the order of their ids, and the sort is stable: of equal scores the first stays.
        self.best[size] = both.iloc[np.lexsort((-both["score"].to_numpy(), both["i"].to_numpy()))].drop_duplicates("i")
        self.floor[size] = floor

    def rows(self) -> pd.DataFrame:
        parts = [b.assign(query_id=self.asked[size][0][b["i"].to_numpy(int)])[["query_id", "vendor_id", "score"]] for size, b in self.best.items() if len(b)]
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vendor_id": [], "score": []})


def vector_top1(queries: DataFrame, vectors: DataFrame, threshold: float = COSINE_THRESHOLD, blocks: int = 16, but_itself: bool = False, queries_each: int = 4_096) -> DataFrame:
    """Nearest vector of the same workspace for each query, if its cosine reaches ``threshold``; ``but_itself``
    passes over the vector with the query's own id.  Of equal cosines the smallest id wins.

    ``queries``: workspace_id, query_id, embedding.  ``vectors``: workspace_id, vendor_id, embedding.
    Queries are dealt to parts of about ``queries_each``, vectors to ``blocks``; each part meets each block of its
    workspace.  The queries of a part come first in the sorted shuffle and are held as a matrix, the vectors pass by
    in batches; the best of each block is found before the blocks are united.
    """
    parts = max(1, -(-queries.count() // queries_each))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    known = queries.schema["query_id"].dataType, vectors.schema["vendor_id"].dataType, queries.schema["workspace_id"].dataType
    query_type, vendor_type, space_type = (t.simpleString() for t in known)
    values = lambda: F.col("embedding").cast("array<double>").alias("embedding")
    q = queries.filter("embedding is not null and query_id is not null").select("workspace_id", "query_id", F.lit(None).cast(vendor_type).alias("vendor_id"), values())
    v = vectors.filter("embedding is not null").select("workspace_id", F.lit(None).cast(query_type).alias("query_id"), "vendor_id", values())
    both = q.withColumn("part", of("query_id", parts)).withColumn("block", every(blocks)).withColumn("kind", F.lit(0)).unionByName(v.withColumn("part", every(parts)).withColumn("block", of("vendor_id", blocks)).withColumn("kind", F.lit(1)))
    place = ["workspace_id", "block", "part"]

    def find(batches):
        now, waiting, near = None, [], None

        def told() -> pd.DataFrame:
            return near.rows().assign(workspace_id=now[0])[["workspace_id", "query_id", "vendor_id", "score"]]

        for b in batches:
            # A batch is cut where another part begins; rows are sorted, so the first rows of a part are its queries.
            starts = (b[place] != b[place].shift()).any(axis=1).cumsum()
            for _, rows in b.groupby(starts, sort=False):
                key = tuple(rows[place].iloc[0])
                if key != now:
                    if near is not None:
                        yield told()
                    now, waiting, near = key, [], None
                asked, held = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
                if len(asked):
                    waiting.append(asked[["query_id", "embedding"]])
                if len(held) and waiting and near is None:
                    all_ = pd.concat(waiting)
                    near, waiting = _Nearest(all_["query_id"], all_["embedding"], but_itself), []
                if len(held) and near is not None:
                    near.add(held["vendor_id"], held["embedding"])
        if near is not None:
            yield told()

    # Sorted by the ids themselves; to Python they go as text, as integers beside nulls would lose digits there.
    dealt = both.filter("workspace_id is not null").repartition(*place).sortWithinPartitions(*place, "kind", "vendor_id")
    said = [F.col(c).cast("string").alias(c) for c in ("workspace_id", "query_id", "vendor_id")]
    dealt = dealt.select(said[0], "block", "part", "kind", said[1], said[2], "embedding")
    scored = dealt.mapInPandas(find, "workspace_id string, query_id string, vendor_id string, score double")
    scored = scored.select(F.col("workspace_id").cast(space_type).alias("workspace_id"), F.col("query_id").cast(query_type).alias("query_id"), F.col("vendor_id").cast(vendor_type).alias("vendor_id"), "score")
    best = scored.groupBy("workspace_id", "query_id").agg(F.min(F.struct((-F.col("score")).alias("o"), "vendor_id", "score")).alias("b"))
    return best.select("workspace_id", "query_id", "b.vendor_id", "b.score").filter(F.col("score") >= threshold)
