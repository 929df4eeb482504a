"""Invoices, documents, vendors, batches and lines derived from the relational test tables.

The tables hold no invoices; these views make some with every property that the operators care about:
repeated numbers, missing vendors and dates, four ways to write an amount, review states and tenants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.plan import once
from leafmill.operators.schemas import EXTRACTED, FIELDS

MONEY = "decimal(18,4)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(n: int) -> Column:
    return F.col("id") % n


def amount_text(x: Column) -> Column:
    """An amount in one of four styles, by the invoice's id."""
    plain = x.cast("decimal(18,2)").cast("string")
    grouped = F.format_number(x.cast("decimal(18,2)"), 2)
    return F.when(_mod(4) == 0, plain).when(_mod(4) == 1, F.concat(F.lit("$"), grouped)).when(_mod(4) == 2, F.translate(grouped, ",.", ".,")).otherwise(F.translate(grouped, ",.", " ,"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, li, s = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem", "supplier"))
    ext, disc, tax = F.col("l_extendedprice").cast(MONEY), F.col("l_discount").cast("decimal(6,4)"), F.col("l_tax").cast("decimal(6,4)")
    net = ext * (1 - disc)
    sums = li.groupBy("l_orderkey").agg(F.sum(net).cast(MONEY).alias("subtotal"), F.sum((net.cast("decimal(20,6)") * tax)).cast(MONEY).alias("tax_amount"), F.min("l_suppkey").alias("vendor_id"), F.count("*").alias("n_lines"))
    who = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", "c_name", F.concat(F.lit("ws"), F.col("n_regionkey").cast("string")).alias("workspace_id"))
    base = o.join(who, o["o_custkey"] == who["c_custkey"]).join(sums, o["o_orderkey"] == sums["l_orderkey"], "left").join(s.select("s_suppkey", "s_name"), F.col("vendor_id") == s["s_suppkey"], "left")
    base = base.withColumn("id", F.col("o_orderkey"))
    day = F.to_date("o_orderdate")
    due = F.when(_mod(13) == 0, None).when(_mod(11) == 0, F.date_add(day, -1)).otherwise(F.date_add(day, 30))
    currency = F.when(_mod(17) == 0, "$").when(_mod(5) == 0, "EUR").when(_mod(5) == 1, "GBP").otherwise("USD")
    terms = F.when(_mod(6) == 0, "Net 30").when(_mod(6) == 1, "Due on  Receipt").when(_mod(6) == 2, "cash").when(_mod(6) == 3, "45 days").otherwise(None)
    overall = ((_mod(101) * 37) % 101).cast("decimal(5,2)") / 100
    rows = base.select(
        "id", F.sha2(F.col("id").cast("string"), 256).alias("document_id"), "workspace_id", (_mod(20)).alias("batch_id"), "vendor_id", F.col("s_name").alias("vendor_name"), F.concat(F.lit("INV-"), _mod(5000).cast("string")).alias("invoice_number"),
        F.date_format(day, "yyyy-MM-dd").alias("invoice_date"), F.date_format(due, "yyyy-MM-dd").alias("due_date"), F.col("c_name").alias("buyer_name"), "subtotal", "tax_amount", F.when(_mod(97) == 0, 0).otherwise(F.col("o_totalprice").cast(MONEY)).cast(MONEY).alias("total_amount"),
        currency.alias("currency"), terms.alias("payment_terms"), F.when(_mod(3) == 0, F.concat(F.lit("PO-"), F.col("id").cast("string"))).alias("purchase_order"), (F.col("o_orderstatus") == "P").alias("needs_review"), F.col("o_orderdate").alias("created_at"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        overall.cast("decimal(4,3)").alias("overall"), F.col("o_orderstatus").alias("order_status"),
    )
    key = F.when(_mod(2) == 0, "overall").otherwise("overall_score")
    return rows.withColumn("confidence_breakdown", F.concat(F.lit('{"'), key, F.lit('": '), F.col("overall").cast("string"), F.lit("}")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = invoices(spark, sf_dir)
    status = F.when(_mod(50) == 0, "processing").when(F.col("order_status") == "F", "complete").when(F.col("order_status") == "P", "needs_review").otherwise("failed")
    kind = F.when(_mod(7) == 0, "image").when(_mod(7) == 1, "email").otherwise("text_pdf")
    return i.select(F.col("document_id").alias("id"), "workspace_id", F.concat(F.lit("scan_"), F.col("id").cast("string"), F.lit(".pdf")).alias("filename"), "batch_id", status.alias("status"), kind.alias("document_type"), (F.col("id") * 10 % 9973).alias("file_size_bytes"), "created_at")


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"])
    k = F.col("s_suppkey")
    return joined.select(
        k.alias("vendor_id"), F.concat(F.lit("ws"), F.col("n_regionkey").cast("string")).alias("workspace_id"), F.col("s_name").alias("canonical_name"), F.array(F.concat(F.col("s_name"), F.lit(" Inc")), F.concat(F.lit("V"), k.cast("string"))).alias("aliases"),
        F.when(k % 4 == 0, "pending_review").otherwise("active").alias("status"), F.concat(F.lpad((k % 90 + 10).cast("string"), 2, "0"), F.lit("-"), F.lpad(k.cast("string"), 7, "0")).alias("tax_id"), F.col("n_name").alias("address"),
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    g = d.groupBy("workspace_id", "batch_id").agg(F.count("*").alias("total"), F.min("created_at").alias("created_at"))
    return g.select("workspace_id", "batch_id", F.concat(F.lit("Batch "), F.col("batch_id").cast("string")).alias("name"), (F.col("batch_id") % 5 == 0).alias("is_archived"), F.lit("web").alias("upload_source"), "total", "created_at")


def lines(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Raw line items with a description; some rows are totals, taxes or discounts by their part.

    ``of`` (invoice_id): only those of these invoices, which are told before any text is made.
    """
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    if of is not None:
        li = li.join(of, li["l_orderkey"] == of["invoice_id"], "left_semi")
    k = F.col("l_partkey")
    word = F.when(k % 11 == 0, "Discount 10%").when(k % 13 == 0, "TVA 20%").when(k % 17 == 0, "Sub total").when(k % 19 == 0, "Grand Total").when(k % 23 == 0, "Shipping and handling").when(k % 29 == 0, "Continued from page 1")
    q, ext = F.col("l_quantity").cast("decimal(18,2)"), F.col("l_extendedprice").cast("decimal(18,2)")
    cents = F.expr("cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint) div cast(l_quantity as bigint)")
    price = F.concat((F.floor(cents / 100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    total = F.when(F.col("l_orderkey") % 9 == 0, ext + 7).when(F.col("l_orderkey") % 10 == 0, None).otherwise(ext)
    df = li.join(p.select("p_partkey", "p_name", "p_type"), li["l_partkey"] == p["p_partkey"])
    return df.select(
        F.col("l_orderkey").alias("invoice_id"), "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(word, F.concat_ws(" ", "p_type", "p_name")).alias("description"),
        q.cast("string").alias("quantity"), price.alias("unit_price"), total.cast("decimal(18,2)").cast("string").alias("total"), "l_extendedprice",
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted records: every field with a confidence, some blank, and a text that holds most values."""
    i = invoices(spark, sf_dir)
    value = {
        "invoice_number": F.when(_mod(31) == 0, None).otherwise(F.col("invoice_number")), "invoice_date": F.when(_mod(37) == 0, "soon").otherwise(F.col("invoice_date")), "due_date": F.col("due_date"),
        "vendor_name": F.when(_mod(41) == 0, "12-34").when(_mod(43) == 0, "X").otherwise(F.col("vendor_name")), "vendor_address": F.lit(None).cast("string"), "vendor_tax_id": F.when(_mod(2) == 0, "12-3456789"), "buyer_name": F.col("buyer_name"), "buyer_address": F.lit(" "),
        "subtotal": amount_text(F.col("subtotal")), "tax_amount": F.when(_mod(29) == 0, "n/a").when(_mod(23) == 0, F.concat(F.lit("-"), amount_text(F.col("tax_amount")))).otherwise(amount_text(F.col("tax_amount"))), "total_amount": F.when(_mod(10) < 3, amount_text((F.col("subtotal") + F.col("tax_amount")).cast(MONEY))).otherwise(amount_text(F.col("total_amount"))),
        "currency": F.col("currency"), "payment_terms": F.col("payment_terms"), "purchase_order": F.col("purchase_order"),
    }
    # Every operator uses the values many times: they are written once.
    i = once(i, {f"_{f}": value[f].cast("string") for f in FIELDS})
    value = {f: F.col(f"_{f}") for f in FIELDS}
    none = F.lit(None)
    field = lambda k, f: F.struct(value[f].alias("value"), F.when(value[f].isNull(), 0.0).otherwise(((F.col("id") * (k + 3)) % 100).cast("double") / 100).alias("confidence"), none.cast("string").alias("evidence"), none.cast("int").alias("page"), none.cast("array<double>").alias("bbox"))
    fields = F.struct(*[field(k, f).alias(f) for k, f in enumerate(FIELDS)])
    none_lines = F.from_json(F.lit('{"line_items": [], "rich_line_items": []}'), EXTRACTED)
    extracted = F.struct(*[fields[f].alias(f) for f in FIELDS], none_lines["line_items"].alias("line_items"), none_lines["rich_line_items"].alias("rich_line_items"))
    text = F.concat_ws(" ", F.lit("Invoice"), value["invoice_number"], F.lit("of"), value["invoice_date"], F.when(_mod(8) != 0, value["vendor_name"]), value["buyer_name"], F.when(_mod(9) != 0, value["total_amount"]), value["subtotal"], value["currency"], value["payment_terms"])
    matched = (_mod(3) != 1) & F.col("vendor_name").isNotNull()
    return i.select("id", "document_id", "workspace_id", "vendor_id", "needs_review", "created_at", F.lit(None).cast("array<struct<page_num:int,text:string,words:array<struct<text:string,bbox:array<double>,page:int,confidence:double>>>>").alias("pages"), extracted.alias("extracted"), text.alias("raw_text"), matched.alias("vendor_matched"))
