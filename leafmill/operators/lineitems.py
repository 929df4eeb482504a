"""Line items: choose the list, classify rows, check their arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.amounts import parse_decimal
from leafmill.functions.plan import bound
from leafmill.functions.text import classify_row_type, quoted
from leafmill.operators.schemas import CELL, RICH_LINE, ROW_TYPES

TOLERANCE = 0.05


def rich_items(extracted: Column, pages: Column) -> Column:
    """The rich list if it has rows, else the plain one promoted to items of page 0."""
    rich = F.coalesce(extracted["rich_line_items"], F.array().cast(f"array<{RICH_LINE}>"))
    plain = F.coalesce(extracted["line_items"], F.array())
    cell = lambda c: F.struct(*[c[k].alias(k) for k in ("value", "confidence", "evidence", "page", "bbox")], c["evidence"].alias("source_evidence")).cast(CELL)
    page = F.when(F.size(pages) > 0, F.lit(0))
    promoted = F.transform(
        plain,
        lambda i: F.struct(
            *[cell(i[k]).alias(k) for k in ("description", "quantity", "unit_price", "total")],
            F.lit("item").alias("row_type"),
            F.lit(None).cast("boolean").alias("math_valid"),
            page.alias("page"),
            F.lit(0).alias("table_index"),
        ).cast(RICH_LINE),
    )
    return F.when(F.size(rich) > 0, rich).otherwise(promoted)


def row_type(item: Column) -> Column:
    """Given types stay, except item and unknown, which the description decides."""
    given = item["row_type"]
    return F.when(given.isin(*[k for k in ROW_TYPES if k not in ("item", "unknown")]), given).otherwise(classify_row_type(item["description"]["value"]))


def math_holds(quantity: Column, price: Column, total: Column) -> Column:
    """Whether quantity times price is the total, within 0.05 or 1 %; null if one cannot be read."""
    def holds(x: Column) -> Column:
        product, t = x["product"], x["t"]
        gap = F.abs(product - F.abs(t))
        near = (gap <= F.lit(TOLERANCE).cast("decimal(4,2)")) | ((product != 0) & (gap < F.abs(product) * F.lit("0.01").cast("decimal(3,2)")))
        return F.when(x["q"].isNull() | x["p"].isNull() | t.isNull(), F.lit(None).cast("boolean")).otherwise(near)

    read = F.struct(*[parse_decimal(x).alias(a) for a, x in (("q", quantity), ("p", price), ("t", total))])
    return bound(bound(read, lambda x: F.struct(x["q"].alias("q"), x["p"].alias("p"), x["t"].alias("t"), (x["q"] * x["p"]).cast("decimal(38,10)").alias("product"))), holds)


def check_rows(items: Column) -> Column:
    """Items with their row type and arithmetic; only items and unknown rows are checked."""

    def one(i: Column) -> Column:
        return bound(row_type(i), lambda kind: with_kind(i, kind))

    def with_kind(i: Column, kind: Column) -> Column:
        ok = F.when(kind.isin("item", "unknown"), math_holds(i["quantity"]["value"], i["unit_price"]["value"], i["total"]["value"]))
        return i.withField("row_type", kind).withField("math_valid", ok)

    return F.transform(items, one)


def math_errors(items: Column) -> Column:
    """A sentence for each row whose arithmetic fails."""
    value = lambda i, k: F.coalesce(i[k]["value"], F.lit("None"))
    said = F.transform(
        items,
        lambda i, n: F.when(
            ~i["math_valid"],
            F.concat(F.lit("Line "), (n + 1).cast("string"), F.lit(" math mismatch: "), quoted(i["description"]["value"]), F.lit(" qty="), value(i, "quantity"), F.lit(" × price="), value(i, "unit_price"), F.lit(" ≠ total="), value(i, "total")),
        ),
    )
    return F.filter(said, lambda s: s.isNotNull())


def extract_line_items(docs: DataFrame) -> DataFrame:
    """Adds ``items`` and ``math_errors`` to rows with ``extracted`` and ``pages``."""
    return docs.withColumn("items", check_rows(rich_items(F.col("extracted"), F.col("pages")))).withColumn("math_errors", math_errors(F.col("items")))
