"""Small pieces that the text operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a longest run without space, tab, line feed, vertical tab, form feed or carriage return.
SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only; other letters stay as they are."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Bound the bytes of a batch that goes to Python, so that a worker's memory does not depend on how long texts are.

    Sets ``spark.sql.execution.arrow.maxBytesPerBatch`` of the session where it is larger.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.match(r"-?\d+", str(spark.conf.get(key)))[0])
    if now <= 0 or now > size:
        spark.conf.set(key, str(size))


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: the session's ``spark.checkpoint.dir``, or where none is named,
    as in tests, one below the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


class Scratch:
    """Tables between the steps of one operator, written to the shared folder and dropped when done with.

    A written table cuts the lineage as a checkpoint does, takes a fraction of its room and can be
    dropped at once.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.names = spark, f"{shared_folder(spark)}/leafmill_{uuid.uuid4().hex}", set()

    def table(self, name: str, df: DataFrame) -> DataFrame:
        self.names.add(name)
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Drop tables, and let the driver forget the plans of finished steps: Spark then removes their shuffle files."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            self.names.discard(name)
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()

    def keep(self, *names: str) -> None:
        """Drop all tables but these."""
        self.drop(*sorted(self.names - set(names)))


def hidden(df: DataFrame, *without: str) -> tuple[DataFrame, list[Column], dict[str, str]]:
    """``df`` with its columns under names that clash with none of an operator's own, the columns as they
    were, and the new name of each.  Columns named in ``without``, the operator's results, go."""
    df = df.drop(*without)
    names = {c: f"_in{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), [F.col(new).alias(old) for old, new in names.items()], names


def with_place(df: DataFrame, name: str = "_place") -> DataFrame:
    """``df`` with a number for each row that stays the same whenever the plan runs again.

    Rows of a scan have one by their place in it.  A plan with a shuffle may deal its rows otherwise the
    next time, so its result is written to the shared folder first.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = Scratch(df.sparkSession).table("placed", df)
    return df.withColumn(name, F.monotonically_increasing_id())


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder that all executors share and cut its lineage there.

    See ``shared_folder``; rows are few here, for many there is ``Scratch``.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of an array<struct<kind,start,end>>, comma-joined in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ranked(df: DataFrame, groups: list[str], order: list[str], tmp: Scratch, name: str) -> DataFrame:
    """``df`` with ``_rank``, its row's number (from 0) in its group by ``order`` (nulls first), and ``_total``, the group's rows.

    A sort by ranges deals the rows of a large group to many tasks; each task numbers its own, and the rows of
    earlier tasks are added, so that no group is in one task.  The result reads a table of ``tmp``.
    """
    by = [F.col(c).asc_nulls_first() for c in [*groups, *order]]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    rows = tmp.table(name, placed.withColumn("_part", F.shiftright("_id", 33)))
    runs = rows.groupBy("_part", *groups).agg(F.min("_id").alias("_from"), F.count("*").alias("_n"))
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(over))
    runs = runs.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_from", "_before", "_total")
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(runs, same).select(*df.columns, (F.col("_id") - F.col("_from") + F.col("_before")).alias("_rank"), "_total")
