"""Streams: windows over events, arrivals without repeats, file ingestion, vendor memory kept as state, notices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from leafmill.functions.plan import cut, remove_folder, shared_folder
from leafmill.operators.vendors import EVENT, MEMORY, MEMORY_NAMES, NO_MEMORY, remember


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, time_col: str, width: str, keys: list[str], delay: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums in windows of ``width`` (sliding by ``slide``); rows later than ``delay`` are left out."""
    w = F.window("_t", width, slide or width)
    timed = events.withColumn("_t", F.col(time_col).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_t", delay)
    return timed.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(28,4)").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time_col: str, gap: str, key: str) -> DataFrame:
    """Sessions of ``key`` that end after a pause of ``gap``."""
    timed = events.withColumn("_t", F.col(time_col).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_t", gap)
    return timed.groupBy(F.session_window("_t", gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_seen(stream: DataFrame, hash_col: str, time_col: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows whose hash is new; with a time column the hashes are forgotten after ``delay``."""
    if not stream.isStreaming:
        return stream.dropDuplicates([hash_col])
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([hash_col]) if time_col else stream.dropDuplicates([hash_col])


MEMORY_OUT = f"workspace_id string, vendor_id long, {MEMORY}"


def _remember(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold a vendor's new invoices into its state, in their order."""
    memory = tuple(state.get) if state.exists else NO_MEMORY
    memory = tuple(list(x) if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else x for x in memory)
    # A vendor has few invoices in a micro-batch, mostly: columns as lists, as a frame of each costs more than its rows.
    rows = [r for b in batches for r in zip(*(b[c].tolist() for c in ("ord", *EVENT)))]
    for _, *event in sorted(rows, key=lambda r: (True, 0) if r[0] is None or r[0] != r[0] else (False, r[0])):
        memory = remember(memory, event)
    state.update(memory)
    yield pd.DataFrame([(*key, *memory)], columns=["workspace_id", "vendor_id", *MEMORY_NAMES])


def memory_stream(invoices: DataFrame) -> DataFrame:
    """Vendor memory after each micro-batch: (workspace_id, vendor_id) with ord and the columns of ``EVENT``."""
    return invoices.groupBy("workspace_id", "vendor_id").applyInPandasWithState(_remember, MEMORY_OUT, MEMORY, "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, keys: list[str], mode: str = "update", conf: dict[str, str] | None = None) -> DataFrame:
    """Process all that is there and return the latest row of each of ``keys``.

    Each micro-batch writes its rows below a folder of its own, which a repeat of the batch replaces.  Rows, state and
    progress lie in a new folder that all executors share; it goes once the latest rows stand in a checkpoint, and
    after a failure as well.  ``conf`` holds for this query.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        writer = stream.writeStream.outputMode(mode).foreachBatch(put).trigger(availableNow=True)
        writer.option("checkpointLocation", f"{folder}/progress").start().awaitTermination()
        rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/rows")
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys], F.lit(0).alias("_")), "batch").alias("r"))
        return cut(latest.select(*keys, *[F.col("r").getField(c).alias(c) for c in stream.columns if c not in keys]))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        remove_folder(spark, folder)


def upsert_sink(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch goes through ``apply(batch, batch_id)``; the batch id makes a repeat harmless."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_stream(spark: SparkSession, path: str, workspace: str) -> DataFrame:
    """Files as they arrive below ``path``, identified and classified."""
    from leafmill.sources.files import ALLOWED_TYPES, MAX_BYTES, classify_mime, content_id, mime_type

    schema = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    df = df.withColumns({"workspace_id": F.lit(workspace), "mime_type": mime_type(F.col("path"))})
    fit = df.filter(F.col("mime_type").isin(*ALLOWED_TYPES) & (F.col("length") <= MAX_BYTES))
    return fit.withColumns({"id": content_id(F.col("content"), F.col("workspace_id")), "document_type": classify_mime(F.col("mime_type"))})
