"""From an extracted record to typed, canonical values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.amounts import money, parse_amount
from leafmill.functions.dates import free_date
from leafmill.functions.text import normalize_currency, parse_date


def canonical_values(extracted: Column) -> Column:
    """Dates, currency and amounts of a record."""
    v = lambda f: extracted[f]["value"]
    day = lambda text: F.coalesce(parse_date(text), free_date(text))
    return F.struct(
        day(v("invoice_date")).alias("invoice_date"),
        day(v("due_date")).alias("due_date"),
        normalize_currency(v("currency")).alias("currency"),
        money(parse_amount(v("subtotal"))).alias("subtotal"),
        money(parse_amount(v("tax_amount"))).alias("tax_amount"),
        money(parse_amount(v("total_amount"))).alias("total_amount"),
    )


def canonicalize(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Adds ``canonicalized``, ``vendor_id`` and ``vendor_matched``; ``resolved`` is (workspace_id, name, vendor_id, how)."""
    found = resolved.select("workspace_id", F.col("name").alias("_name"), "vendor_id", F.col("how").alias("_how"))
    keyed = records.withColumn("_name", F.col("extracted.vendor_name.value"))
    out = keyed.join(found, ["workspace_id", "_name"], "left")
    matched = F.coalesce(F.col("_how").isin("fuzzy", "vector"), F.lit(False))
    return out.withColumns({"canonicalized": canonical_values(F.col("extracted")), "vendor_matched": matched}).drop("_name", "_how")
