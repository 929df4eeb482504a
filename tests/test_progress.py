"""Progress of a stream's batches, and the choice of a provider."""

import datetime

from pyspark.sql import functions as F


def test_listener_counts_until_all_is_done(spark, tmp_path):
    from leafmill.streaming.progress import ProgressListener, counted

    docs = spark.range(60).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 6 == 0, "failed").when(F.col("id") % 6 == 1, "processing").otherwise("complete").alias("status"))
    for part in range(3):
        docs.filter(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = ProgressListener()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = counted(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        steps = list(listener.poll(str(q.id), 50, every=0.1))
        q.awaitTermination()
    finally:
        spark.streams.removeListener(listener)
    assert steps[-1] == {"rows": 60, "done": 50, "failed": 10, "total": 50}
    assert [s["done"] for s in steps] == sorted(s["done"] for s in steps)
    assert listener.table(spark).agg(F.sum("done"), F.count("*")).first()[0] == 50
    clock = iter(range(100))
    assert list(listener.poll("unknown", 5, patience=3, clock=lambda: next(clock), wait=lambda s: None)) == [{"rows": 0, "done": 0, "failed": 0, "total": 5}]


def test_choice_has_a_lifetime(spark):
    from leafmill.operators.providers import LIFETIME, ModelRetired, Service, ask_in_order

    def first(model, text, at):
        if at % 1_000_000 >= 100:
            raise RuntimeError("quota")
        if model == "old":
            raise ModelRetired(model)
        return f"{model} {text}"

    services = (Service("first", ("old", "older", "new"), lambda at: at % 1_000_000 < 100, lambda m, t, at: first("old" if m == "older" else m, t, at)), Service("second", ("only",), lambda at: at % 1_000_000 < 900, lambda m, t, at: f"{m} {t}"))
    start = 10**9
    assert start % 1_000_000 == 0 and LIFETIME == 300
    times = [0, 50, 150, 300, 301, 700, 950, 1050]
    calls = [("a", datetime.datetime.fromtimestamp(start + t, datetime.timezone.utc), i, f"t{i}") for i, t in enumerate(times)] + [("b", datetime.datetime.fromtimestamp(start + 950, datetime.timezone.utc), 100, "x"), (None, None, 101, "x")]
    df = spark.createDataFrame(calls, "caller string, at timestamp, id int, text string").repartition(3)
    got = {r["id"]: (r["provider"], r["model"], r["answer"], r["error"]) for r in ask_in_order(df, services).collect()}
    assert got[0] == ("first", "new", "new t0", None) and got[1] == ("first", "new", "new t1", None)
    # Dead, but kept until the choice is too old.
    assert got[2] == got[3] == ("first", "new", None, "quota")
    assert got[4] == ("second", "only", "only t4", None) and got[5] == ("second", "only", "only t5", None) and got[6] == ("second", "only", "only t6", None)
    assert got[7] == ("second", "only", None, "no provider") and got[100] == (None, None, None, "no provider") and 101 not in got
