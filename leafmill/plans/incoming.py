"""Files in and bundles out: ingestion, readers of every kind, counters, vectors of names, the finished session."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions.plan import cut, remove_folder, shared_folder
from leafmill.operators.vendors import vendor_vectors
from leafmill.plans.reading import positioned
from leafmill.plans.records import _embedding
from leafmill.plans.registry import query
from leafmill.plans.sql import with_views
from leafmill.sources import domain as D
from leafmill.sources.bundle import finish_session, read_bundle
from leafmill.sources.domain import table
from leafmill.sources.files import cascade, classify_mime, mime_type, put_files, read_pages, scan
from leafmill.sources.sinks import observed


@query("q_ingest", with_views("SELECT sha256(canonical_name || chr(10) || workspace_id || chr(10) || 'ws') AS id, 'text/plain' AS mime_type, 'text_pdf' AS document_type, 'processing' AS status, strlen(canonical_name || workspace_id) + 2 AS length FROM vend"))
def q_ingest(spark, sf):
    """A file for each vendor, found again by the scan of the folder."""
    folder = shared_folder(spark, "incoming")
    v = D.vendors(spark, sf).select(F.concat(F.col("vendor_id").cast("string"), F.lit(".txt")).alias("name"), F.concat_ws("\n", "canonical_name", "workspace_id", F.lit("")).alias("content"))
    try:
        put_files(v, folder)
        found = scan(spark, folder, "ws", "*.txt")
        return cut(found.select("id", "mime_type", "document_type", "status", "length"))
    finally:
        remove_folder(spark, folder)


def _clear(content: bytes, mime: str) -> list[dict]:
    """An engine that is sure of texts of an even length, and fails on those whose length ends in 7."""
    text = content.decode()
    if len(text) % 10 == 7:
        raise ValueError("no engine")
    return [{"text": f"clear {text}", "words": [{"text": text, "bbox": [0.0, 0.0, 1.0, 1.0], "page": 0, "confidence": c} for c in (0.1, 0.9 if len(text) % 2 == 0 else 0.3)]}]


def _patient(content: bytes, mime: str) -> list[dict]:
    return [{"text": f"patient {content.decode()}", "words": []}]


def _broken(content: bytes, mime: str) -> list[dict]:
    raise ValueError("cannot be read")


_READ = "CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN ' ' || text || ' ' WHEN 2 THEN 'Subject: Bill ' || doc_id || chr(10) || text WHEN 3 THEN CASE WHEN length(text) % 10 <> 7 AND length(text) % 2 = 0 THEN 'clear ' ELSE 'patient ' END || text ELSE '' END"


@query("q_read_pages", f"SELECT doc_id, sha256({_READ}) AS digest, CAST(doc_id % 5 <> 4 AS INTEGER) AS n_pages, CASE WHEN doc_id % 5 = 4 THEN 'cannot be read' END AS error FROM documents")
def q_read_pages(spark, sf):
    """Documents as plain text, HTML, mails, images with two engines, and PDF whose reader fails."""
    d, k, text = table(spark, sf, "documents"), F.col("doc_id") % 5, F.col("text")
    marked = F.concat(F.lit("<p>"), F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</p>"))
    mail = F.concat(F.lit("Subject: Bill "), F.col("doc_id").cast("string"), F.lit("\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), text)
    name = F.concat(F.lit("f."), F.when(k == 0, "txt").when(k == 1, "html").when(k == 2, "eml").when(k == 3, "png").otherwise("pdf"))
    body = F.when(k == 1, marked).when(k == 2, mail).otherwise(text)
    files = d.select(F.col("doc_id").cast("string").alias("id"), body.cast("binary").alias("content"), mime_type(name).alias("mime_type")).withColumn("document_type", classify_mime(F.col("mime_type")))
    read = read_pages(files, {"image": cascade(_clear, _patient), "pdf": _broken})
    return read.select(F.col("id").cast("long").alias("doc_id"), F.sha2("raw_text", 256).alias("digest"), F.size("pages").alias("n_pages"), F.get("errors", F.lit(0))["message"].alias("error"))


@query("q_metrics", with_views("SELECT count(*) AS rows, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'needs_review') AS needs_review FROM docs"))
def q_metrics(spark, sf):
    """Counters that are filled while another action runs over the documents."""
    docs, counters = observed(D.documents(spark, sf), "documents")
    docs.write.format("noop").mode("overwrite").save()
    got = counters.get
    return spark.createDataFrame([(got["rows"], got["failed"], got["needs_review"])], "rows long, failed long, needs_review long")


@query("q_name_vectors", with_views(f"SELECT vendor_id, array_to_string(list_transform({_embedding('canonical_name')}, lambda x: x::INTEGER), ',') AS vector FROM vend"))
def q_name_vectors(spark, sf):
    v = vendor_vectors(D.vendors(spark, sf))
    return v.select("vendor_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query("q_finish_session", with_views("SELECT 'json' AS part, count(*) AS n FROM inv WHERE workspace_id = 'ws1' UNION ALL SELECT 'invoices', count(*) FROM inv WHERE workspace_id = 'ws1' UNION ALL SELECT 'lines', count(*) FROM lin JOIN inv ON invoice_id = id WHERE workspace_id = 'ws1' UNION ALL SELECT 'bytes', count(*) FROM inv WHERE workspace_id = 'ws1' UNION ALL SELECT 'left', count(*) FROM inv WHERE workspace_id <> 'ws1'"))
def q_finish_session(spark, sf):
    """A tenant's bundle, read again from what was published, and the invoices that the purge leaves."""
    invoices = D.invoices(spark, sf).withColumn("validation_report", F.lit(None).cast("string"))
    tables = {"invoices": invoices, "documents": D.documents(spark, sf), "vendors": D.vendors(spark, sf), "line_items": positioned(D.lines(spark, sf))}
    contents = tables["documents"].select("workspace_id", "id", F.col("filename").cast("binary").alias("content"))
    folder = shared_folder(spark, "bundle")
    try:
        left = finish_session(tables, folder, "ws1", contents, lambda ids: positioned(D.lines(spark, sf, ids)))
        out = left["invoices"].agg(F.lit("left").alias("part"), F.count("*").alias("n"))
        for part in ("json", "invoices", "lines", "bytes"):
            out = out.unionByName(read_bundle(spark, folder, part).agg(F.lit(part).alias("part"), F.count("*").alias("n")))
        return cut(out)
    finally:
        remove_folder(spark, folder)
