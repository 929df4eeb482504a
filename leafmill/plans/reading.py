"""Search, queue, dashboard, pages, details and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions.text import confidence_bucket, last_of
from leafmill.operators import reports as R
from leafmill.plans.registry import query
from leafmill.plans.sql import with_views
from leafmill.sources import domain as D

_COLUMNS = "i.id, i.document_id, invoice_number, v.canonical_name AS vendor_name, invoice_date, CASE WHEN total_amount <> 0 THEN CAST(total_amount AS VARCHAR) END AS total_amount, currency, needs_review, filename, d.status AS document_status"


def _search_sql(where: str, offset: int, limit: int) -> str:
    hit = f"SELECT {_COLUMNS}, i.created_at FROM inv i JOIN docs d ON i.document_id = d.id LEFT JOIN vend v ON i.vendor_id = v.vendor_id WHERE {where}"
    return with_views(f"SELECT * EXCLUDE (created_at) FROM (SELECT *, count(*) OVER () AS total FROM ({hit})) ORDER BY created_at DESC, id LIMIT {limit} OFFSET {offset}")


_SEARCHES = {
    "text": ({"q": "7%1"}, "(invoice_number ILIKE '%7%1%' OR v.canonical_name ILIKE '%7%1%' OR filename ILIKE '%7%1%')"),
    "vendor": ({"vendor": "00000003"}, "v.canonical_name ILIKE '%00000003%'"),
    "number": ({"number": "inv-12"}, "invoice_number ILIKE '%inv-12%'"),
    "dates": ({"date_from": "1996-01-01", "date_to": "1996-03-31"}, "invoice_date >= '1996-01-01' AND invoice_date <= '1996-03-31'"),
    "status_review": ({"status": "needs_review"}, "needs_review"),
    "status_approved": ({"status": "approved"}, "NOT needs_review"),
    "status_failed": ({"status": "failed"}, "d.status = 'failed'"),
    "confidence": ({"min_confidence": 0.9}, "overall >= 0.9"),
    "batch_page": ({"batch_id": 7, "offset": 20, "limit": 30}, "d.batch_id = 7"),
    "tenant": ({"workspace": "ws2", "limit": 200}, "i.workspace_id = 'ws2'"),
}


def _register_search(name: str, options: dict, where: str) -> None:
    sql = _search_sql(where, options.get("offset", 0), options.get("limit", 50))

    @query(f"q_search_{name}", sql)
    def run(spark, sf):
        return R.search(D.invoices(spark, sf), D.documents(spark, sf), D.vendors(spark, sf), **options)


for _name, (_options, _where) in _SEARCHES.items():
    _register_search(_name, _options, _where)


@query("q_queue", with_views("SELECT i.id, i.document_id, filename, d.status AS document_status, i.vendor_id, v.canonical_name AS vendor_name, invoice_number, invoice_date, due_date, buyer_name, CASE WHEN total_amount <> 0 THEN CAST(total_amount AS VARCHAR) END AS total_amount, currency, payment_terms, needs_review FROM inv i JOIN docs d ON i.document_id = d.id LEFT JOIN vend v ON i.vendor_id = v.vendor_id WHERE needs_review AND i.workspace_id = 'ws1' ORDER BY i.created_at DESC, i.id LIMIT 100"))
def q_queue(spark, sf):
    return R.review_queue(D.invoices(spark, sf), D.documents(spark, sf), D.vendors(spark, sf), "ws1")


@query("q_queue_client_search", with_views("SELECT i.id, filename, v.canonical_name AS vendor_name, invoice_number FROM inv i JOIN docs d ON i.document_id = d.id LEFT JOIN vend v ON i.vendor_id = v.vendor_id WHERE needs_review AND (contains(lower(filename), '77') OR coalesce(contains(lower(v.canonical_name), '77'), false) OR contains(lower(invoice_number), '77'))"))
def q_queue_client_search(spark, sf):
    queue = R.review_queue(D.invoices(spark, sf), D.documents(spark, sf), D.vendors(spark, sf), limit=None)
    return R.client_search(queue, "77").select("id", "filename", "vendor_name", "invoice_number")


@query("q_recent_documents", with_views("SELECT id, filename, status, created_at FROM docs ORDER BY created_at DESC, id LIMIT 10"))
def q_recent(spark, sf):
    return R.page(D.documents(spark, sf), [F.desc("created_at"), "id"], limit=10).select("id", "filename", "status", "created_at")


@query("q_vendors_page", with_views("SELECT vendor_id, canonical_name, status, 0 AS invoice_count FROM vend ORDER BY canonical_name, vendor_id LIMIT 30 OFFSET 10"))
def q_vendors_page(spark, sf):
    v = R.vendor_list(D.vendors(spark, sf).withColumn("invoice_count", F.lit(None).cast("int")))
    return R.page(v, ["canonical_name", "vendor_id"], 10, 30).drop("aliases")


@query("q_vendors_named", with_views("SELECT vendor_id, canonical_name FROM vend WHERE contains(lower(canonical_name), 'v1') OR contains(lower(canonical_name || ' Inc'), 'v1') OR contains(lower('V' || vendor_id), 'v1')"))
def q_vendors_named(spark, sf):
    return R.vendors_named(D.vendors(spark, sf), "v1").select("vendor_id", "canonical_name")


@query("q_batches_page", with_views("SELECT workspace_id, batch_id, name, total FROM bat WHERE NOT is_archived ORDER BY created_at DESC, workspace_id, batch_id LIMIT 20 OFFSET 5"))
def q_batches_page(spark, sf):
    b = D.batches(spark, sf).filter(~F.col("is_archived"))
    return R.page(b, [F.desc("created_at"), "workspace_id", "batch_id"], 5, 20).select("workspace_id", "batch_id", "name", "total")


@query("q_batch_documents", with_views("SELECT id, filename, created_at FROM docs WHERE batch_id = 3 AND workspace_id = 'ws0'"))
def q_batch_documents(spark, sf):
    return D.documents(spark, sf).filter("batch_id = 3 and workspace_id = 'ws0'").orderBy("created_at", "id").select("id", "filename", "created_at")


@query("q_failed_documents", with_views("SELECT id, batch_id FROM docs WHERE batch_id = 4 AND status = 'failed'"))
def q_failed_documents(spark, sf):
    return D.documents(spark, sf).filter("batch_id = 4 and status = 'failed'").select("id", "batch_id")


@query("q_point_lookup", with_views("SELECT id, invoice_number, workspace_id FROM inv WHERE id = 33"))
def q_point_lookup(spark, sf):
    return D.invoices(spark, sf).filter("id = 33").select("id", "invoice_number", "workspace_id")


_STATS = """SELECT i.*, failed_documents, processing_documents, complete_documents, storage_bytes, total_batches FROM
 (SELECT workspace_id, count(*) AS total_invoices, count(*) FILTER (WHERE needs_review) AS needs_review, count(*) FILTER (WHERE NOT needs_review) AS approved FROM inv GROUP BY 1) i
 JOIN (SELECT workspace_id, count(*) FILTER (WHERE status = 'failed') AS failed_documents, count(*) FILTER (WHERE status = 'processing') AS processing_documents, count(*) FILTER (WHERE status = 'complete') AS complete_documents, CAST(sum(file_size_bytes) AS BIGINT) AS storage_bytes FROM docs GROUP BY 1) d USING (workspace_id)
 JOIN (SELECT workspace_id, count(*) AS total_batches FROM bat GROUP BY 1) b USING (workspace_id)"""


@query("q_stats", with_views(_STATS))
def q_stats(spark, sf):
    return R.stats(D.invoices(spark, sf), D.documents(spark, sf), D.batches(spark, sf))


@query("q_storage", with_views("SELECT CAST(coalesce(sum(file_size_bytes), 0) AS BIGINT) AS storage_bytes FROM docs"))
def q_storage(spark, sf):
    return D.documents(spark, sf).agg(F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("long").alias("storage_bytes"))


@query("q_top_vendors", with_views("SELECT canonical_name, count(*) AS invoice_count, CAST(round(100 * count(*) / max(count(*)) OVER ()) AS INTEGER) AS percent FROM vend v JOIN inv i ON i.vendor_id = v.vendor_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def q_top_vendors(spark, sf):
    return R.top_vendors(D.invoices(spark, sf), D.vendors(spark, sf))


@query("q_status_tally", with_views("SELECT count(*) FILTER (WHERE status = 'needs_review') AS needs_review, count(*) FILTER (WHERE status IN ('pending', 'processing')) AS running, count(*) FILTER (WHERE status = 'complete') AS complete FROM docs"))
def q_status_tally(spark, sf):
    s = F.col("status")
    return D.documents(spark, sf).agg(F.count_if(s == "needs_review").alias("needs_review"), F.count_if(s.isin("pending", "processing")).alias("running"), F.count_if(s == "complete").alias("complete"))


@query("q_confidence_buckets", with_views("SELECT CASE WHEN overall >= 0.90 THEN 'green' WHEN overall >= 0.75 THEN 'yellow' ELSE 'red' END AS bucket, count(*) AS n FROM inv GROUP BY 1"))
def q_confidence_buckets(spark, sf):
    return D.invoices(spark, sf).groupBy(confidence_bucket(F.col("overall")).alias("bucket")).agg(F.count("*").alias("n"))


def positioned(lines):
    """Lines with their position in the invoice."""
    w = Window.partitionBy("invoice_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines.withColumn("position", F.row_number().over(w) - 1).withColumnsRenamed({k: f"{k}_raw" for k in ("description", "quantity", "unit_price", "total")})


_POSITION = "CAST(row_number() OVER (PARTITION BY invoice_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER)"


@query("q_invoice_detail", with_views(f"SELECT i.id, p.position, p.description, CASE WHEN i.total_amount <> 0 THEN CAST(i.total_amount AS VARCHAR) END AS total_amount, p.total FROM inv i JOIN (SELECT *, {_POSITION} AS position FROM lin) p ON p.invoice_id = i.id WHERE i.workspace_id = 'ws3'"))
def q_invoice_detail(spark, sf):
    from leafmill.operators.state import unpivot_fields

    i = D.invoices(spark, sf).filter("workspace_id = 'ws3'")
    detail = R.invoice_detail(i, unpivot_fields(D.records(spark, sf)), positioned(D.lines(spark, sf)).withColumns({"row_type": F.lit("item"), "math_valid": F.lit(None).cast("boolean")}))
    return detail.select("id", "total_amount", F.explode("line_items").alias("l")).select("id", "l.position", F.col("l.description_raw").alias("description"), "total_amount", F.col("l.total_raw").alias("total"))


@query("q_document_detail", with_views("SELECT d.id, d.status, i.invoice_number, CASE WHEN i.total_amount <> 0 THEN CAST(i.total_amount AS VARCHAR) END AS total_amount FROM docs d LEFT JOIN inv i ON i.document_id = d.id WHERE d.workspace_id = 'ws4'"))
def q_document_detail(spark, sf):
    d = R.document_detail(D.documents(spark, sf).filter("workspace_id = 'ws4'"), D.invoices(spark, sf))
    return d.select("id", "status", "invoice.invoice_number", "invoice.total_amount")


_EXPORT = """SELECT invoice_number, canonical_name AS vendor, v.tax_id AS vendor_tax_id, v.address AS vendor_address, buyer_name, invoice_date, due_date, payment_terms, purchase_order, currency, subtotal, tax_amount, total_amount, CAST(overall AS DOUBLE) AS confidence,
 (i.id % 5) || 'P / ' || (i.id % 3) || 'F / 0W' AS validation_status, CASE WHEN needs_review THEN 'Needs Review' ELSE 'Approved' END AS review_status, d.batch_id, i.document_id, filename FROM inv i LEFT JOIN docs d ON i.document_id = d.id LEFT JOIN vend v ON i.vendor_id = v.vendor_id"""


@query("q_export_invoices", with_views(_EXPORT))
def q_export_invoices(spark, sf):
    report = F.to_json(F.struct((F.col("id") % 5).alias("passed"), (F.col("id") % 3).alias("failed"), F.lit(0).alias("warnings")))
    return R.export_invoices(D.invoices(spark, sf).withColumn("validation_report", report), D.documents(spark, sf), D.vendors(spark, sf))


@query("q_export_lines", with_views(f"SELECT invoice_id, {_POSITION} AS position, invoice_number, canonical_name AS vendor, description, quantity, unit_price, l.total AS line_total FROM inv i JOIN lin l ON l.invoice_id = i.id LEFT JOIN vend v ON i.vendor_id = v.vendor_id"))
def q_export_lines(spark, sf):
    return R.export_lines(D.invoices(spark, sf), D.vendors(spark, sf), positioned(D.lines(spark, sf)))


@query("q_export_filters", with_views("SELECT id, invoice_number FROM inv WHERE batch_id = 6 AND invoice_date >= '1995-01-01' AND invoice_date <= '1997-12-31' AND NOT needs_review"))
def q_export_filters(spark, sf):
    return R.export_filter(D.invoices(spark, sf), D.documents(spark, sf), batch_id=6, start=" 1995-01-01", end="1997-12-31", review_status="approved").select("id", "invoice_number")


@query("q_export_ids", with_views("SELECT id, invoice_number FROM inv WHERE id IN (1, 2, 3, 35, 36, 37) AND vendor_id IS NOT NULL"))
def q_export_ids(spark, sf):
    return R.export_filter(D.invoices(spark, sf), D.documents(spark, sf), ids=[1, 2, 3, 35, 36, 37]).filter("vendor_id is not null").select("id", "invoice_number")


@query("q_export_pdf_rows", with_views("SELECT id, coalesce(invoice_number, '—') AS invoice_number, coalesce(canonical_name, '—') AS vendor, coalesce(invoice_date, '—') AS invoice_date, coalesce(due_date, '—') AS due_date, coalesce(currency, '—') AS currency, coalesce(CAST(CAST(subtotal AS DECIMAL(18,2)) AS VARCHAR), '—') AS subtotal, coalesce(CAST(CAST(tax_amount AS DECIMAL(18,2)) AS VARCHAR), '—') AS tax_amount, coalesce(CAST(CAST(total_amount AS DECIMAL(18,2)) AS VARCHAR), '—') AS total_amount, CASE WHEN needs_review THEN 'Review' ELSE 'OK' END AS status FROM inv i LEFT JOIN vend v ON i.vendor_id = v.vendor_id"))
def q_export_pdf_rows(spark, sf):
    return R.export_pdf_rows(D.invoices(spark, sf), D.vendors(spark, sf))


@query("q_export_json", with_views("SELECT id, CAST(subtotal AS VARCHAR) AS subtotal, n_lines FROM inv WHERE workspace_id = 'ws0'"))
def q_export_json(spark, sf):
    out = R.export_json(D.invoices(spark, sf).filter("workspace_id = 'ws0'"), positioned(D.lines(spark, sf)))
    return out.select("id", F.get_json_object("json", "$.subtotal").alias("subtotal"), F.coalesce(F.json_array_length(F.get_json_object("json", "$.line_items")), F.lit(0)).cast("long").alias("n_lines"))


@query("q_vendor_last_numbers", with_views("SELECT vendor_id, string_agg(invoice_number, ',' ORDER BY id) AS numbers FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY id DESC) AS n FROM inv WHERE vendor_id IS NOT NULL) WHERE n <= 5 GROUP BY 1"))
def q_vendor_last_numbers(spark, sf):
    last = Window.partitionBy("vendor_id").orderBy(F.desc("id"))
    few = D.invoices(spark, sf).filter("vendor_id is not null").select("vendor_id", "id", "invoice_number", F.row_number().over(last).alias("n")).filter("n <= 5")
    kept = few.groupBy("vendor_id").agg(F.array_sort(F.collect_list(F.struct("id", "invoice_number"))).alias("x"))
    return kept.select("vendor_id", F.array_join(F.transform(last_of(F.col("x"), 5), lambda s: s["invoice_number"]), ",").alias("numbers"))


@query("q_tenant_counts", with_views("SELECT i.workspace_id, n_invoices, n_batches FROM (SELECT workspace_id, count(*) AS n_invoices FROM inv GROUP BY 1) i JOIN (SELECT workspace_id, count(*) AS n_batches FROM bat GROUP BY 1) b ON i.workspace_id = b.workspace_id"))
def q_tenant_counts(spark, sf):
    n = D.invoices(spark, sf).groupBy("workspace_id").agg(F.count("*").alias("n_invoices"))
    return n.join(D.batches(spark, sf).groupBy("workspace_id").agg(F.count("*").alias("n_batches")), "workspace_id")
