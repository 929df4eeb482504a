"""Windows, sessions and vendor memory over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions.plan import remove_folder, shared_folder, written
from leafmill.plans.extras import _KEEP
from leafmill.plans.registry import query
from leafmill.plans.records import _EVENTS, _FOLD, memory_events
from leafmill.plans.sql import VIEWS
from leafmill.sources import domain as D
from leafmill.sources.domain import table
from leafmill.streaming import streams as S
from leafmill.streaming.ordered import STORE, ordered_memory
from leafmill.streaming.progress import batch_progress


def _events(spark, sf):
    return S.event_stream(spark, f"{sf}/[e]vents.parquet", table(spark, sf, "events").schema)


@query("q_stream_tumbling", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS total FROM events GROUP BY 1, 2")
def q_stream_tumbling(spark, sf):
    out = S.run_once(S.tumbling_counts(_events(spark, sf), "ts", "1 day", ["event_type"]), ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("q_sliding", "SELECT s::TIMESTAMP AS start, event_type, count(*) AS n FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1, 2")
def q_sliding(spark, sf):
    out = S.tumbling_counts(table(spark, sf, "events"), "ts", "2 hours", ["event_type"], slide="1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("q_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def q_sessions(spark, sf):
    return S.sessions(table(spark, sf, "events"), "ts", "6 hours", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("q_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def q_stream_dedup(spark, sf):
    # Hashes are forgotten a month after they were first seen, which is the span of the events.
    keyed = _events(spark, sf).withColumns({"h": F.sha2(F.concat_ws("|", "user_id", "event_type"), 256), "_t": F.col("ts").cast("timestamp")}).select("h", "user_id", "event_type", "_t")
    return S.run_once(S.first_seen(keyed, "h", "_t", "31 days"), ["user_id", "event_type"], "append").select("user_id", "event_type")


@query("q_stream_memory", f"WITH RECURSIVE {VIEWS}, {_EVENTS}, {_FOLD}, e AS (SELECT workspace_id, vendor_id, arg_max(ema, n) AS ema, arg_max(rate, n) AS rate FROM f GROUP BY 1, 2), a AS (SELECT workspace_id, vendor_id, CAST(count(*) AS INTEGER) AS invoice_count, arg_min(currency, ord) FILTER (WHERE currency IS NOT NULL) AS preferred_currency, arg_min(terms, ord) FILTER (WHERE terms IS NOT NULL) AS preferred_terms, arg_min(tax_id, ord) FILTER (WHERE tax_id IS NOT NULL) AS tax_id, CAST(count(DISTINCT tax_id) AS INTEGER) AS n_tax_ids, CAST(least(500, count(DISTINCT number)) AS INTEGER) AS n_numbers FROM ev GROUP BY 1, 2) SELECT a.*, CAST(ema AS DECIMAL(9,3)) AS ema, CAST(rate AS DECIMAL(9,3)) AS rate FROM a JOIN e USING (workspace_id, vendor_id)")
def q_stream_memory(spark, sf):
    folder = shared_folder(spark, "memory_events")
    events = memory_events(spark, sf)
    try:
        events.write.parquet(folder)
        out = S.run_once(S.memory_stream(S.event_stream(spark, folder, events.schema, 10_000)), ["workspace_id", "vendor_id"])
    finally:
        remove_folder(spark, folder)
    return out.select("workspace_id", "vendor_id", "invoice_count", "preferred_currency", F.col("preferred_payment_terms").alias("preferred_terms"), "tax_id", F.size("tax_ids").alias("n_tax_ids"), F.size("historical_invoice_numbers").alias("n_numbers"), F.col("avg_confidence").cast("decimal(9,3)").alias("ema"), F.col("rate_purchase_order").cast("decimal(9,3)").alias("rate"))


_KEPT = f"per AS (SELECT ev.workspace_id, ev.vendor_id, ev.n, coalesce(list_sort(list(description) FILTER (description IS NOT NULL)), []) AS p FROM ev LEFT JOIN lin ON lin.invoice_id = ev.ord GROUP BY ALL), kept AS (SELECT workspace_id, vendor_id, n, {_KEEP.format(b='p')} AS k FROM per WHERE n = 1 UNION ALL SELECT t.workspace_id, t.vendor_id, t.n, {_KEEP.format(b='t.b')} FROM (SELECT per.workspace_id, per.vendor_id, per.n, kept.k || per.p AS b FROM kept JOIN per ON per.workspace_id = kept.workspace_id AND per.vendor_id = kept.vendor_id AND per.n = kept.n + 1) t)"


@query("q_stream_memory_ordered", f"WITH RECURSIVE {VIEWS}, {_EVENTS}, {_FOLD}, {_KEPT}, e AS (SELECT workspace_id, vendor_id, arg_max(ema, n) AS ema, arg_max(rate, n) AS rate, CAST(max(n) AS INTEGER) AS invoice_count FROM f GROUP BY 1, 2), k AS (SELECT workspace_id, vendor_id, array_to_string(arg_max(k, n), '|') AS products FROM kept GROUP BY 1, 2) SELECT e.workspace_id, e.vendor_id, invoice_count, products, CAST(ema AS DECIMAL(9,3)) AS ema, CAST(rate AS DECIMAL(9,3)) AS rate FROM e JOIN k USING (workspace_id, vendor_id)")
def q_stream_memory_ordered(spark, sf):
    """The invoices lie in files dealt by a hash, eight a micro-batch: most come before earlier ones.

    A key of the state has 16 vendors' numbers, which are up to 80 vendors as each tenant has its own.
    """
    bought = D.lines(spark, sf).groupBy(F.col("invoice_id").alias("ord")).agg(F.sort_array(F.collect_list("description")).alias("products"))
    events = memory_events(spark, sf).join(bought, "ord", "left").withColumn("at", F.timestamp_millis(F.col("ord") + 10**12))
    buckets = max(256, table(spark, sf, "supplier").count() // 16)
    folder = shared_folder(spark, "memory_events")
    try:
        written(events.repartition(32, F.xxhash64("ord")), folder)
        stream = S.event_stream(spark, folder, events.schema, 8)
        out = S.run_once(ordered_memory(stream, "30 days", buckets), ["workspace_id", "vendor_id"], conf=STORE)
    finally:
        remove_folder(spark, folder)
    return out.select("workspace_id", "vendor_id", "invoice_count", F.array_join("products", "|").alias("products"), F.col("avg_confidence").cast("decimal(9,3)").alias("ema"), F.col("rate_purchase_order").cast("decimal(9,3)").alias("rate"))


@query("q_memory_batch_counts", f"WITH {VIEWS}, {_EVENTS} SELECT workspace_id, vendor_id, CAST(count(*) AS INTEGER) AS invoice_count, arg_min(currency, ord) AS preferred_currency FROM ev GROUP BY 1, 2")
def q_memory_batch_counts(spark, sf):
    e = memory_events(spark, sf)
    return e.groupBy("workspace_id", "vendor_id").agg(F.count("*").cast("int").alias("invoice_count"), F.min_by("currency", "ord").alias("preferred_currency"))


@query("q_batch_progress", f"WITH {VIEWS} SELECT workspace_id, batch_id, count(*) AS seen, count(*) FILTER (WHERE status <> 'processing') AS done, count(*) FILTER (WHERE status = 'failed') AS failed FROM docs GROUP BY 1, 2")
def q_batch_progress(spark, sf):
    """The documents come in files, one a micro-batch; the last row of a batch of documents counts all of it."""
    docs = D.documents(spark, sf).select("workspace_id", "batch_id", "id", "status")
    folder = shared_folder(spark, "batch_documents")
    try:
        docs.repartition(4, F.xxhash64("id")).write.parquet(folder)
        return S.run_once(batch_progress(S.event_stream(spark, folder, docs.schema, 1)), ["workspace_id", "batch_id"])
    finally:
        remove_folder(spark, folder)
