"""State changes: upsert, review, purge, migration, admission, counters and the long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import reports as R
from leafmill.operators import state as S
from leafmill.plans import sql as Q
from leafmill.plans.registry import query
from leafmill.plans.sql import with_views
from leafmill.sources import domain as D
from leafmill.sources.domain import table

_STORED = [(k, f, v) for k, (f, v) in Q.FIELD_VALUES if f in ("invoice_number", "invoice_date", "due_date", "buyer_name", "subtotal", "tax_amount", "total_amount", "currency", "payment_terms", "purchase_order")]


@query("q_field_unpivot", with_views(" UNION ALL ".join(f"SELECT id AS invoice_id, '{f}' AS field_name, {v} AS raw_value, CAST({Q.confidence(k, v)} AS DECIMAL(4,3)) AS confidence, {Q.confidence(k, v)} < 0.75 AS needs_review, NOT needs_review AS reviewed FROM rec" for k, f, v in _STORED)))
def q_field_unpivot(spark, sf):
    return S.unpivot_fields(D.records(spark, sf)).select("invoice_id", "field_name", "raw_value", "confidence", "needs_review", "reviewed")


def _errors():
    error = lambda fatal: F.array(F.struct(F.lit("s").alias("stage"), F.lit(fatal).alias("fatal")))
    return F.when(F.col("id") % 8 == 0, error(True)).when(F.col("id") % 8 == 1, error(False)).otherwise(F.array().cast("array<struct<stage:string,fatal:boolean>>"))


@query("q_status", with_views("SELECT id, CASE WHEN id % 8 = 0 THEN 'failed' WHEN needs_review THEN 'needs_review' ELSE 'complete' END AS status FROM inv"))
def q_status(spark, sf):
    return D.invoices(spark, sf).select("id", S.document_status(_errors(), F.col("needs_review")).alias("status"))


@query("q_audit", with_views("SELECT document_id, 'persist' AS stage, 'upsert' AS action, sha256('{\"currency\":\"' || currency || '\",\"invoice_number\":\"' || invoice_number || '\"}') AS after_hash FROM inv"))
def q_audit(spark, sf):
    after = F.to_json(F.struct("currency", "invoice_number"))
    return S.audit_rows(D.invoices(spark, sf), "persist", "upsert", after=after).select("document_id", "stage", "action", "after_hash")


@query("q_upsert", with_views("SELECT id, filename, CASE WHEN substr(id, 1, 1) = 'a' THEN 'reprocessed' ELSE status END AS status FROM docs UNION ALL SELECT 'new-' || substr(id, 1, 8), 'n.pdf', 'reprocessed' FROM docs WHERE substr(id, 1, 2) = 'ab'"))
def q_upsert(spark, sf):
    d = D.documents(spark, sf).withColumn("errors", F.array().cast("array<string>"))
    again = d.filter("substr(id, 1, 1) = 'a'").withColumns({"status": F.lit("reprocessed"), "filename": F.lit("ignored")})
    new = d.filter("substr(id, 1, 2) = 'ab'").withColumns({"id": F.concat(F.lit("new-"), F.substring("id", 1, 8)), "status": F.lit("reprocessed"), "filename": F.lit("n.pdf")})
    return S.upsert_documents(d, again.unionByName(new)).select("id", "filename", "status")


@query("q_replace", with_views("SELECT id, invoice_number FROM inv WHERE id % 10 <> 1 UNION ALL SELECT id, 'R-' || id FROM inv WHERE id % 10 = 1"))
def q_replace(spark, sf):
    i = D.invoices(spark, sf).select("id", "invoice_number")
    return S.replace_rows(i, i.filter("id % 10 = 1").withColumn("invoice_number", F.concat(F.lit("R-"), F.col("id").cast("string"))), "id")


_IDS = [1, 2, 3, 64, 65, 66, 67, 1000]
_IN = f"({', '.join(map(str, _IDS))})"


@query("q_approve", with_views(f"SELECT i.id, CASE WHEN i.id IN {_IN} THEN false ELSE needs_review END AS needs_review, CASE WHEN i.id IN {_IN} THEN 'complete' ELSE d.status END AS status FROM inv i JOIN docs d ON i.document_id = d.id"))
def q_approve(spark, sf):
    fields = S.unpivot_fields(D.records(spark, sf))
    i, _, d, _ = S.approve(D.invoices(spark, sf), fields, D.documents(spark, sf), _IDS)
    return i.select("id", "document_id", "needs_review").join(d.select(F.col("id").alias("document_id"), "status"), "document_id").select("id", "needs_review", "status")


@query("q_approve_fields", with_views(f"SELECT count(*) AS n, count(*) FILTER (WHERE id IN {_IN} OR NOT needs_review) AS reviewed FROM inv, range(10)"))
def q_approve_fields(spark, sf):
    _, f, _, _ = S.approve(D.invoices(spark, sf), S.unpivot_fields(D.records(spark, sf)), D.documents(spark, sf), _IDS)
    return f.agg(F.count("*").alias("n"), F.count_if("reviewed").alias("reviewed"))


@query("q_reject", with_views(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN i.id IN {_IN} THEN 'failed' ELSE d.status END AS status FROM inv i JOIN docs d ON i.document_id = d.id) GROUP BY 1"))
def q_reject(spark, sf):
    _, d, _ = S.reject(D.invoices(spark, sf), D.documents(spark, sf), _IDS)
    return d.groupBy("status").agg(F.count("*").alias("n"))


@query("q_correct", with_views(f"SELECT id AS invoice_id, 'currency' AS field_type, currency AS original_value, 'EUR' AS corrected_value FROM inv WHERE id % 3 = 0 AND currency <> 'EUR'"))
def q_correct(spark, sf):
    fields = S.unpivot_fields(D.records(spark, sf))
    c = D.invoices(spark, sf).filter("id % 3 = 0").select(F.col("id").alias("invoice_id"), F.lit("currency").alias("field_name"), F.lit("EUR").alias("value"), F.lit("wrong").alias("reason"))
    return S.correct_fields(fields, c)[1].select("invoice_id", "field_type", "original_value", "corrected_value")


@query("q_vendor_update", with_views("SELECT vendor_id, CASE WHEN vendor_id % 4 = 0 THEN 'active' ELSE status END AS status, canonical_name FROM vend"))
def q_vendor_update(spark, sf):
    v = D.vendors(spark, sf)
    c = v.filter("vendor_id % 4 = 0").select("vendor_id", F.lit(None).cast("string").alias("canonical_name"), F.lit(None).cast("array<string>").alias("aliases"), F.lit("active").alias("status"))
    return S.update_vendors(v, c).select("vendor_id", "status", "canonical_name")


def tables(spark, sf):
    lines = D.lines(spark, sf).select("invoice_id", "description")
    spaces = D.invoices(spark, sf).select(F.col("workspace_id").alias("id")).distinct()
    return {"invoices": D.invoices(spark, sf), "documents": D.documents(spark, sf), "vendors": D.vendors(spark, sf), "batches": D.batches(spark, sf), "line_items": lines, "workspaces": spaces}


_COUNTS = "SELECT 'invoices' AS name, count(*) AS n FROM inv WHERE {w} UNION ALL SELECT 'documents', count(*) FROM docs WHERE {w} UNION ALL SELECT 'vendors', count(*) FROM vend WHERE {w} UNION ALL SELECT 'batches', count(*) FROM bat WHERE {w}"


@query("q_purge", with_views(_COUNTS.format(w="workspace_id NOT IN ('ws1', 'ws3')") + " UNION ALL SELECT 'line_items', count(*) FROM lin JOIN inv ON invoice_id = id WHERE workspace_id NOT IN ('ws1', 'ws3') UNION ALL SELECT 'workspaces', count(DISTINCT workspace_id) FROM inv WHERE workspace_id NOT IN ('ws1', 'ws3')"))
def q_purge(spark, sf):
    gone = spark.createDataFrame([("ws1",), ("ws3",)], "workspace_id string")
    out = None
    for name, t in S.purge(tables(spark, sf), gone).items():
        n = t.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("q_migrate", with_views("SELECT 'invoices' AS name, CASE WHEN workspace_id = 'ws0' THEN 'ws4' ELSE workspace_id END AS workspace_id, count(*) AS n FROM inv GROUP BY 2 UNION ALL SELECT 'documents', CASE WHEN workspace_id = 'ws0' THEN 'ws4' ELSE workspace_id END, count(*) FROM docs GROUP BY 2"))
def q_migrate(spark, sf):
    moved = S.migrate(tables(spark, sf), "ws0", "ws4")
    n = lambda t: moved[t].groupBy("workspace_id").agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "workspace_id", "n")
    return n("invoices").unionByName(n("documents"))


@query("q_expired", with_views("SELECT vendor_id FROM vend WHERE vendor_id % 2 = 0 AND vendor_id % 3 <> 0"))
def q_expired(spark, sf):
    k = F.col("vendor_id")
    w = D.vendors(spark, sf).select("vendor_id", F.when(k % 2 == 0, "guest").otherwise("authenticated").alias("workspace_type"), F.when(k % 3 != 0, F.timestamp_seconds(k)).alias("expires_at"))
    return S.expired(w).select("vendor_id")


@query("q_trial", with_views("SELECT id, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at, id) <= 5 AS admitted FROM inv"))
def q_trial(spark, sf):
    i = D.invoices(spark, sf)
    uses = i.select("workspace_id").distinct().withColumn("uses_left", F.lit(5))
    asked, _ = S.admit(i.select("workspace_id", F.col("id").alias("request_id"), F.col("created_at").alias("arrival")), uses)
    return asked.select(F.col("request_id").alias("id"), "admitted")


_COUNTERS = "SELECT b.workspace_id, b.batch_id, CAST(CAST(sum(CAST(file_size_bytes % 101 AS DECIMAL(18,4)) / 100) / count(*) AS DECIMAL(18,6)) AS DECIMAL(4,3)) AS avg_confidence, count(*) FILTER (WHERE status IN ('complete', 'needs_review')) AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, greatest(0, any_value(b.total) - count(*) FILTER (WHERE status IN ('complete', 'needs_review', 'failed'))) AS pending FROM bat b JOIN docs d ON b.batch_id = d.batch_id AND b.workspace_id = d.workspace_id GROUP BY 1, 2"


@query("q_batch_counters", with_views(_COUNTERS))
def q_batch_counters(spark, sf):
    d = D.documents(spark, sf).withColumn("confidence", (F.col("file_size_bytes") % 101).cast("decimal(18,4)") / 100)
    return S.batch_counters(d, D.batches(spark, sf)).select("workspace_id", "batch_id", "completed", "failed", "pending", "avg_confidence")


@query("q_retry", with_views(f"SELECT c.workspace_id, c.batch_id, completed + (SELECT count(*) FROM docs d WHERE d.workspace_id = c.workspace_id AND d.status = 'failed' AND d.batch_id = c.batch_id AND substr(d.id, 1, 1) < '8') AS completed, greatest(0, failed - (SELECT count(*) FROM docs d WHERE d.workspace_id = c.workspace_id AND d.status = 'failed' AND d.batch_id = c.batch_id AND substr(d.id, 1, 1) < '8')) AS failed FROM ({_COUNTERS}) c"))
def q_retry(spark, sf):
    d = D.documents(spark, sf).withColumn("confidence", F.lit(0.5))
    b = S.batch_counters(d, D.batches(spark, sf))
    again = d.filter("status = 'failed'").select("workspace_id", "batch_id", (F.substring("id", 1, 1) < "8").alias("ok"))
    return S.retry_counters(b, again).select("workspace_id", "batch_id", "completed", "failed")


@query("q_projects", with_views("SELECT batch_id, CASE WHEN batch_id = 2 THEN 'Renamed' ELSE name END AS name, batch_id IN (3, 5, 10, 15) OR (is_archived AND batch_id <> 0) AS is_archived FROM bat WHERE workspace_id = 'ws1' AND batch_id <> 0 UNION ALL SELECT 1000, 'Batch 4 (Copy)', false"))
def q_projects(spark, sf):
    b = D.batches(spark, sf).filter("workspace_id = 'ws1'").withColumn("archived_at", F.lit(None).cast("timestamp"))
    d = D.documents(spark, sf).filter("workspace_id = 'ws1'")
    b = S.set_archived(S.duplicate_batch(S.rename_batch(b, 2, "Renamed"), 4, 1000), [3], True)
    return S.delete_batches(b, d, [0, 1])[0].select("batch_id", "name", "is_archived")


_EXPORTED = "x AS (SELECT 1 AS export_id, 'ws1' AS workspace_id, TIMESTAMP '2024-05-01 10:00:00' AS created_at FROM inv WHERE workspace_id = 'ws1' UNION ALL SELECT 2, workspace_id, TIMESTAMP '2024-05-02 11:30:05' FROM inv WHERE workspace_id = 'ws1' AND needs_review UNION ALL SELECT 3, workspace_id, TIMESTAMP '2024-05-03 00:00:09' FROM inv WHERE workspace_id = 'ws2')"


@query("q_export_history", f"WITH {Q.VIEWS}, {_EXPORTED} SELECT export_id, CASE WHEN export_id = 2 THEN 'filtered' ELSE 'all' END AS export_type, CASE WHEN export_id = 2 THEN '{{\"review_status\":\"needs_review\"}}' ELSE '{{}}' END AS filter_params, count(*) AS record_count, 'invoices_export_' || strftime(created_at, '%Y%m%d_%H%M%S') || '.xlsx' AS filename FROM x WHERE workspace_id = 'ws1' GROUP BY export_id, created_at ORDER BY created_at DESC LIMIT 200")
def q_export_history(spark, sf):
    i = D.invoices(spark, sf)
    made = lambda df, n, at: df.select(F.lit(n).alias("export_id"), "workspace_id", F.lit(at).cast("timestamp").alias("created_at"))
    history = S.export_entries(made(i.filter("workspace_id = 'ws1'"), 1, "2024-05-01 10:00:00")).unionByName(S.export_entries(made(i.filter("workspace_id = 'ws2'"), 3, "2024-05-03 00:00:09")))
    history = history.unionByName(S.export_entries(made(i.filter("workspace_id = 'ws1' and needs_review"), 2, "2024-05-02 11:30:05"), {"review_status": "needs_review", "batch_id": None}))
    recent = R.page(R.tenant(history, "ws1"), [F.desc("created_at"), "export_id"], limit=200)
    return recent.select("export_id", "export_type", "filter_params", "record_count", "filename")


@query("q_vector_upsert", "SELECT vec_id AS vendor_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS version, round(CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END * embedding[1]::DOUBLE, 6) AS first FROM embeddings UNION ALL SELECT 1000000 + vec_id, 'new', round(2 * embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id % 10 = 0")
def q_vector_upsert(spark, sf):
    e = table(spark, sf, "embeddings").select(F.lit("w").alias("workspace_id"), F.col("vec_id").cast("long").alias("vendor_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    twice = lambda df, by: df.withColumns({"embedding": F.transform("embedding", lambda x: by * x), "ord": F.lit(by)})
    again = e.filter("vendor_id % 3 = 0")
    new = e.filter("vendor_id % 10 = 0").withColumn("vendor_id", F.col("vendor_id") + 1_000_000)
    out = S.upsert_vectors(e, twice(again, 1).unionByName(twice(again, 2)).unionByName(twice(new, 2)))
    fresh = F.when((F.col("vendor_id") % 3 == 0) & (F.col("vendor_id") < 1_000_000) | (F.col("vendor_id") >= 1_000_000), "new").otherwise("old")
    return out.select("vendor_id", fresh.alias("version"), F.round(F.get("embedding", F.lit(0)), 6).alias("first"))
