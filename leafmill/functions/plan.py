"""Helpers that shape plans."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below the session's ``spark.checkpoint.dir``, or where none is
    named, as in tests, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}_{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of an operator's own, wherever it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Bound the bytes of a batch that goes to Python, so that a worker's memory does not depend on how long texts are.

    Sets ``spark.sql.execution.arrow.maxBytesPerBatch`` of the session where it is larger.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.match(r"-?\d+", str(spark.conf.get(key)))[0])
    if now <= 0 or now > size:
        spark.conf.set(key, str(size))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder that all executors share, and cut its lineage there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as a table that is written to ``folder``; the driver forgets the plan, so that Spark removes its shuffle files.

    A column without a type becomes text, as a table has none.
    """
    spark = df.sparkSession
    df = df.select([F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName() == "void" else F.col(f"`{f.name}`") for f in df.schema])
    df.write.option("compression", "zstd").parquet(folder)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(folder)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once for each row, however often later expressions use them.

    The optimizer copies the expression of a projected column to every use of it, which for expressions
    built on expressions grows without bound; it does not copy what a generator gives.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used: the optimizer does not copy what a variable holds.

    A fold over nothing, as that asks for no types while it runs.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, use)


def numbered(df: DataFrame, groups: list[str], order: list[str], folder: str) -> DataFrame:
    """``df`` with ``_rank``, each row's number (from 0) in its group by ``order``; reads a table that it writes to ``folder``.

    Rows are sorted by ranges and numbered where they lie, then those of earlier tasks are added: no group is in one task.
    """
    by = [F.col(c).asc_nulls_first() for c in [*groups, *order]]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    dealt = dealt.withColumn("_part", F.shiftright("_id", 33))
    dealt.write.parquet(folder)
    rows = df.sparkSession.read.schema(dealt.schema).parquet(folder)
    runs = rows.groupBy("_part", *groups).agg(F.min("_id").alias("_from"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_part", *groups, "_from", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(runs, ["_part", *groups]).select(*df.columns, (F.col("_id") - F.col("_from") + F.col("_before")).alias("_rank"))
