"""Read queries: search, queue, dashboard, pages of tables, details and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def shown_amount(amount: Column) -> Column:
    """A decimal as text; zero shows as null."""
    return F.when(amount != 0, amount.cast(MONEY).cast("string"))


def tenant(df: DataFrame, workspace: str | None) -> DataFrame:
    return df if workspace is None else df.filter(F.col("workspace_id") == workspace)


def overall_score(breakdown: Column) -> Column:
    """The overall score of a JSON breakdown under either of its two keys."""
    return F.coalesce(F.get_json_object(breakdown, "$.overall"), F.get_json_object(breakdown, "$.overall_score")).cast("double")


def search(
    invoices: DataFrame,
    documents: DataFrame,
    vendors: DataFrame,
    workspace: str | None = None,
    q: str | None = None,
    vendor: str | None = None,
    number: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    batch_id=None,
    status: str | None = None,
    min_confidence: float | None = None,
    offset: int = 0,
    limit: int | None = 50,
) -> DataFrame:
    """Invoices with their document and vendor that fit all given filters, newest first, with the ``total`` found.

    Patterns are those of ILIKE: ``%`` and ``_`` in a term are wildcards.
    """
    d = documents.select(F.col("id").alias("document_id"), "filename", "batch_id", F.col("status").alias("document_status"))
    v = vendors.select("vendor_id", "canonical_name")
    df = tenant(invoices.drop("filename", "batch_id", "document_status", "canonical_name"), workspace).join(d, "document_id").join(v, "vendor_id", "left")
    like = lambda c, x: F.col(c).ilike(f"%{x}%")
    if q:
        df = df.filter(like("invoice_number", q) | like("canonical_name", q) | like("filename", q))
    if vendor:
        df = df.filter(like("canonical_name", vendor))
    if number:
        df = df.filter(like("invoice_number", number))
    if date_from:
        df = df.filter(F.col("invoice_date") >= date_from)
    if date_to:
        df = df.filter(F.col("invoice_date") <= date_to)
    if batch_id is not None:
        df = df.filter(F.col("batch_id") == batch_id)
    if status in ("needs_review", "approved"):
        df = df.filter(F.col("needs_review") if status == "needs_review" else ~F.col("needs_review"))
    elif status == "failed":
        df = df.filter(F.col("document_status") == "failed")
    if min_confidence is not None:
        df = df.filter(overall_score(F.col("confidence_breakdown")) >= min_confidence)
    total = df.agg(F.count("*")).scalar()
    page = df.orderBy(F.desc("created_at"), "id").offset(offset)
    page = page if limit is None else page.limit(limit)
    return page.select("id", "document_id", "invoice_number", F.col("canonical_name").alias("vendor_name"), "invoice_date", shown_amount(F.col("total_amount")).alias("total_amount"), "currency", "needs_review", "filename", "document_status", total.alias("total"))


def review_queue(invoices: DataFrame, documents: DataFrame, vendors: DataFrame, workspace: str | None = None, limit: int | None = 100) -> DataFrame:
    """The newest invoices that need review; all without a limit."""
    d = documents.select(F.col("id").alias("document_id"), "filename", F.col("status").alias("document_status"))
    top = tenant(invoices.drop("filename", "document_status", "vendor_name"), workspace).filter("needs_review")
    top = top if limit is None else top.orderBy(F.desc("created_at"), "id").limit(limit)
    df = top.join(d, "document_id", "left").join(vendors.select("vendor_id", F.col("canonical_name").alias("vendor_name")), "vendor_id", "left")
    return df.select("id", "document_id", "filename", "document_status", "vendor_id", "vendor_name", "invoice_number", "invoice_date", "due_date", "buyer_name", shown_amount(F.col("total_amount")).alias("total_amount"), "currency", "payment_terms", "needs_review")


def stats(invoices: DataFrame, documents: DataFrame, batches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of a tenant's dashboard, each table scanned once."""
    keys = by or ["workspace_id"]
    i = invoices.groupBy(*keys).agg(F.count("*").alias("total_invoices"), F.count_if("needs_review").alias("needs_review"), F.count_if(~F.col("needs_review")).alias("approved"))
    state = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_documents")
    d = documents.groupBy(*keys).agg(state("failed"), state("processing"), state("complete"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("long").alias("storage_bytes"))
    b = batches.groupBy(*keys).agg(F.count("*").alias("total_batches"))
    out = i.join(d, keys, "full").join(b, keys, "full")
    return out.select(*keys, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in out.columns if c not in keys])


def top_vendors(invoices: DataFrame, vendors: DataFrame, n: int = 10) -> DataFrame:
    """Names with most invoices, and their part of the first's in percent; vendors of one name count together."""
    counted = invoices.groupBy("vendor_id").agg(F.count("*").alias("n"))
    named = counted.join(vendors.select("vendor_id", "canonical_name"), "vendor_id").groupBy("canonical_name").agg(F.sum("n").alias("invoice_count"))
    top = named.orderBy(F.desc("invoice_count"), "canonical_name").limit(n)
    percent = F.round(F.lit(100) * F.col("invoice_count") / F.max("invoice_count").over(Window.partitionBy())).cast("int")
    return top.withColumn("percent", percent)


def page(df: DataFrame, order: list, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page in a total order; give the key last."""
    out = df.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def invoice_detail(invoices: DataFrame, fields: DataFrame, lines: DataFrame) -> DataFrame:
    """Invoices with their fields and their lines by position, nested."""
    f = fields.groupBy("invoice_id").agg(F.array_sort(F.collect_list(F.struct("field_name", "raw_value", "confidence", "needs_review"))).alias("fields"))
    li = lines.groupBy("invoice_id").agg(F.array_sort(F.collect_list(F.struct("position", "description_raw", "quantity_raw", "unit_price_raw", "total_raw", "row_type", "math_valid"))).alias("line_items"))
    out = invoices.join(f.withColumnRenamed("invoice_id", "id"), "id", "left").join(li.withColumnRenamed("invoice_id", "id"), "id", "left")
    return out.withColumns({"subtotal": shown_amount(F.col("subtotal")), "tax_amount": shown_amount(F.col("tax_amount")), "total_amount": shown_amount(F.col("total_amount"))})


def document_detail(documents: DataFrame, invoices: DataFrame) -> DataFrame:
    """Documents with their invoice nested."""
    i = invoices.select("document_id", F.struct("id", "invoice_number", shown_amount(F.col("total_amount")).alias("total_amount"), "currency", "needs_review").alias("invoice"))
    return documents.join(i, documents["id"] == i["document_id"], "left").drop("document_id")


def export_filter(invoices: DataFrame, documents: DataFrame, ids: list | None = None, batch_id=None, vendor_id=None, start: str | None = None, end: str | None = None, review_status: str | None = None) -> DataFrame:
    """Invoices of an export; documents join only for a batch."""
    df = invoices
    if ids:
        df = df.filter(F.col("id").isin(*ids))
    if batch_id is not None:
        df = df.join(documents.filter(F.col("batch_id") == batch_id).select(F.col("id").alias("document_id")), "document_id")
    if vendor_id is not None:
        df = df.filter(F.col("vendor_id") == vendor_id)
    if start and start.strip():
        df = df.filter(F.col("invoice_date") >= start.strip())
    if end and end.strip():
        df = df.filter(F.col("invoice_date") <= end.strip())
    if review_status in ("needs_review", "approved"):
        df = df.filter(F.col("needs_review") if review_status == "needs_review" else ~F.col("needs_review"))
    return df


def export_invoices(invoices: DataFrame, documents: DataFrame, vendors: DataFrame) -> DataFrame:
    """The 19 columns of the invoice sheet."""
    d = documents.select(F.col("id").alias("document_id"), "filename", "batch_id")
    v = vendors.select("vendor_id", F.col("canonical_name").alias("vendor"), F.col("tax_id").alias("vendor_tax_id"), F.col("address").alias("vendor_address"))
    r = F.col("validation_report")
    n = lambda k: F.coalesce(F.get_json_object(r, f"$.{k}"), F.lit("0"))
    checks = F.when(r.isNull(), "—").otherwise(F.concat(n("passed"), F.lit("P / "), n("failed"), F.lit("F / "), n("warnings"), F.lit("W")))
    df = invoices.drop("filename", "batch_id", "vendor", "vendor_tax_id", "vendor_address").join(d, "document_id", "left").join(v, "vendor_id", "left")
    return df.select(
        "invoice_number", "vendor", "vendor_tax_id", "vendor_address", "buyer_name", "invoice_date", "due_date", "payment_terms", "purchase_order", "currency", "subtotal", "tax_amount", "total_amount",
        F.round(overall_score(F.col("confidence_breakdown")), 4).alias("confidence"), checks.alias("validation_status"), F.when(F.col("needs_review"), "Needs Review").otherwise("Approved").alias("review_status"), "batch_id", "document_id", "filename",
    )


def export_lines(invoices: DataFrame, vendors: DataFrame, lines: DataFrame) -> DataFrame:
    """The six columns of the line sheet, with the position."""
    i = invoices.select(F.col("id").alias("invoice_id"), "invoice_number", "vendor_id").join(vendors.select("vendor_id", F.col("canonical_name").alias("vendor")), "vendor_id", "left")
    return i.join(lines, "invoice_id").select("invoice_id", "position", "invoice_number", "vendor", F.col("description_raw").alias("description"), F.col("quantity_raw").alias("quantity"), F.col("unit_price_raw").alias("unit_price"), F.col("total_raw").alias("line_total"))


def export_pdf_rows(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """The nine columns of the printed table; missing values show as a dash."""
    df = invoices.drop("vendor").join(vendors.select("vendor_id", F.col("canonical_name").alias("vendor")), "vendor_id", "left")
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c)
    amount = lambda c: F.coalesce(F.col(c).cast("decimal(18,2)").cast("string"), F.lit("—")).alias(c)
    return df.select("id", dash("invoice_number"), dash("vendor"), dash("invoice_date"), dash("due_date"), dash("currency"), amount("subtotal"), amount("tax_amount"), amount("total_amount"), F.when(F.col("needs_review"), "Review").otherwise("OK").alias("status"))


def export_json(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """One JSON text an invoice, with its lines by position; decimals as text."""
    li = lines.groupBy("invoice_id").agg(F.array_sort(F.collect_list(F.struct("position", "description_raw", "quantity_raw", "unit_price_raw", "total_raw"))).alias("line_items"))
    df = invoices.join(li.withColumnRenamed("invoice_id", "id"), "id", "left")
    text = [F.col(c).cast(MONEY).cast("string").alias(c) for c in ("subtotal", "tax_amount", "total_amount")]
    return df.select("id", F.to_json(F.struct("id", "invoice_number", "invoice_date", "currency", *text, F.coalesce("line_items", F.array()).alias("line_items"))).alias("json"))


def vendor_list(vendors: DataFrame) -> DataFrame:
    """Vendors with empty lists and zero for nulls."""
    empty = F.array().cast("array<string>")
    return vendors.select("vendor_id", "canonical_name", F.coalesce("aliases", empty).alias("aliases"), "status", F.coalesce("invoice_count", F.lit(0)).alias("invoice_count"))


def client_search(queue: DataFrame, term: str) -> DataFrame:
    """Rows whose file, vendor or number holds the term, whatever the case; no wildcards."""
    low = term.lower()
    return queue.filter(F.greatest(*[F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False)) for c in ("filename", "vendor_name", "invoice_number")]))


def vendors_named(vendors: DataFrame, term: str) -> DataFrame:
    """Vendors whose name or any alias holds the term."""
    low = F.lit(term.lower())
    return vendors.filter(F.contains(F.lower("canonical_name"), low) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), low)))


def mask_secrets(preference: Column) -> Column:
    """A provider preference without its key, but with whether there is one."""
    has = F.coalesce(F.try_element_at(preference, F.lit("encrypted_api_key")) != "", F.lit(False))
    return F.map_concat(F.map_filter(preference, lambda k, v: k != "encrypted_api_key"), F.create_map(F.lit("has_saved_api_key"), has.cast("string")))


# Extraction quality.


def precision_recall(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """precision, recall, f1 and support of boolean columns ``truth`` and ``predicted``; zero where nothing divides."""
    t, p = F.col("truth"), F.col("predicted")
    n = pairs.groupBy(*(by or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = n.withColumns({"precision": div(F.col("tp"), F.col("tp") + F.col("fp")), "recall": div(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("support", F.col("tp") + F.col("fn"))


def accuracy(pairs: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Accuracy of each ``metric`` over ``match``, the macro mean as metric ``overall``, and the change since a previous run."""
    each = pairs.groupBy("metric").agg(F.avg(F.col("match").cast("int")).alias("accuracy"))
    both = each.unionByName(each.agg(F.avg("accuracy").alias("accuracy")).withColumn("metric", F.lit("overall")))
    if previous is None:
        return both.withColumn("delta", F.lit(None).cast("double"))
    return both.join(previous.select("metric", F.col("accuracy").alias("_p")), "metric", "left").withColumn("delta", F.col("accuracy") - F.col("_p")).drop("_p")
