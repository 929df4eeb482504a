"""Progress of batches of documents while they are processed, as rows that can be asked for again and again."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

DONE = ("complete", "needs_review", "failed", "skipped")
SCHEMA = "query string, micro_batch long, at string, rows long, done long, failed long"


def batch_progress(documents: DataFrame) -> DataFrame:
    """(workspace_id, batch_id) with documents seen, done and failed; over a stream, after each micro-batch."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return documents.groupBy("workspace_id", "batch_id").agg(F.count("*").alias("seen"), n(*DONE).alias("done"), n("failed").alias("failed"))


def counted(documents: DataFrame, name: str = "progress") -> DataFrame:
    """``documents`` with counters of each micro-batch that ``ProgressListener`` receives."""
    return documents.observe(name, F.count("*").alias("rows"), F.count_if(F.col("status").isin(*DONE)).alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))


class ProgressListener(StreamingQueryListener):
    """Keeps the counters of the last ``kept`` micro-batches of the queries that use ``counted``, and their sums since the start."""

    def __init__(self, name: str = "progress", kept: int = 1000):
        self.name, self.kept, self.rows, self.sums = name, kept, [], {}

    def onQueryStarted(self, event) -> None:
        self.sums[str(event.id)] = {"rows": 0, "done": 0, "failed": 0}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        if seen is None:
            return
        query, own = str(p.id), {k: int(seen[k]) for k in ("rows", "done", "failed")}
        self.rows = [*self.rows, (query, p.batchId, p.timestamp, *own.values())][-self.kept :]
        total = self.sums.setdefault(query, dict.fromkeys(own, 0))
        for k, v in own.items():
            total[k] += v

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)

    def poll(self, query: str, total: int, every: float = 0.5, patience: float = 60, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep) -> Iterator[dict]:
        """Counters of a query until as many documents are done as there are, or nothing more comes for ``patience`` seconds."""
        last, since = None, clock()
        while True:
            now = dict(self.sums.get(query, {"rows": 0, "done": 0, "failed": 0}))
            if now != last:
                last, since = now, clock()
                yield {**now, "total": total}
            if now["done"] >= total or clock() - since > patience:
                return
            wait(every)
