"""Seed vendors and synthetic invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
SEED_VENDORS = (
    ("Acme Corp", ["ACME Corporation", "Acme Inc", "ACME CORP"], "123 Main St, Springfield, USA", "12-3456789"),
    ("Beta Inc", ["Beta Incorporated", "BETA INC"], "456 Oak Ave, Portland, USA", "98-7654321"),
    ("Gamma Services LLC", ["Gamma Services", "Gamma LLC"], "789 Pine Rd, Austin, USA", "55-1234567"),
    ("Delta Solutions", ["Delta Solutions Inc", "Delta"], "321 Elm Blvd, Seattle, USA", None),
    ("Epsilon Tech", ["Epsilon Technology", "EpsilonTech"], "654 Maple Dr, Boston, USA", None),
)


def seed_vendors(workspaces: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The seed vendors of each tenant (``workspace_id``) that are not there yet by name (``existing``: workspace_id, canonical_name)."""
    rows = F.array(*[F.struct(F.lit(n).alias("canonical_name"), F.array(*map(F.lit, a)).alias("aliases"), F.lit(d).alias("address"), F.lit(t).cast("string").alias("tax_id")) for n, a, d, t in SEED_VENDORS])
    each = workspaces.select("workspace_id").distinct().select("workspace_id", F.inline(rows))
    out = each.select(F.sha2(F.concat_ws("|", "workspace_id", "canonical_name"), 256).alias("vendor_id"), "workspace_id", "canonical_name", "aliases", "address", "tax_id", F.lit("active").alias("status"))
    return out if existing is None else out.join(existing.select("workspace_id", "canonical_name"), ["workspace_id", "canonical_name"], "left_anti").select(*out.columns)


#: vendor, number, currency, tax rate, lines (quantity, unit price) of each invoice. Fixed values.
SYNTHETIC = (
    ("Acme Corp", "ACM-2024-001", "USD", 0.08, ((40, 150.0), (8, 200.0), (5, 100.0))),
    ("ACME Corporation", "ACM-2024-002", "USD", 0.08, ((20, 175.0), (1, 800.0))),
    ("Beta Inc", "BETA-2024-0042", "USD", 0.0, ((1, 4500.0),)),
    ("Beta Incorporated", "BETA-2024-0043", "USD", 0.0, ((1, 4500.0), (1, 500.0), (3, 200.0))),
    ("Gamma Services LLC", "GS-INV-2024-0123", "USD", 0.0, ((720, 0.12), (500, 0.023), (120, 0.09), (1, 65.0))),
    ("Delta Solutions", "DS-2024-INV-789", "USD", 0.10, ((4, 3200.0), (16, 180.0), (8, 220.0), (1, 1500.0))),
    ("Epsilon Technology", "EPS-2024-UK-0056", "EUR", 0.20, ((1, 8500.0), (1, 1200.0), (10, 150.0))),
    ("XYZ Consulting", "", "USD", 0.0, ((1, 2500.0),)),
    ("Zeta Analytics Partners", "ZAP-2024-001", "USD", 0.08, ((1, 3200.0), (40, 125.0))),
    ("Delta Solutions Inc", "DS-2024-INV-999", "USD", 0.10, ((25, 899.0), (25, 450.0), (25, 99.0), (25, 79.0), (25, 149.0), (25, 129.0), (25, 45.0))),
    ("Acme Corp", "ACM-2024-UK-011", "GBP", 0.0, ((1, 2800.0), (15, 220.0))),
    ("Gamma LLC", "GS-2024-ANNUAL-001", "USD", 0.08, ((1, 15000.0), (1, 3600.0), (1, 2500.0), (10, 200.0))),
)


def summed_invoices(invoices: DataFrame) -> DataFrame:
    """Subtotal, tax and total of invoices with ``line_items`` (quantity, unit_price) and ``tax_rate``."""
    sub = F.aggregate("line_items", F.lit(0.0), lambda s, i: s + i["quantity"] * i["unit_price"])
    df = invoices.withColumn("subtotal", sub.cast("decimal(18,2)"))
    return df.withColumn("tax_amount", (F.col("subtotal") * F.col("tax_rate")).cast("decimal(18,2)")).withColumn("total_amount", (F.col("subtotal") + F.col("tax_amount")).cast("decimal(18,2)"))


def synthetic_invoices(spark: SparkSession) -> DataFrame:
    """The synthetic invoices of the seed."""
    rows = [(v, n, c, r, [{"quantity": float(q), "unit_price": p} for q, p in li]) for v, n, c, r, li in SYNTHETIC]
    return summed_invoices(spark.createDataFrame(rows, "vendor_name string, invoice_number string, currency string, tax_rate double, line_items array<struct<quantity:double,unit_price:double>>"))


def synthetic_for(buyers: DataFrame) -> DataFrame:
    """The synthetic invoices for each buyer (``buyer_id`` and ``scale``): its quantities are ``scale`` times those of the seed."""
    items = lambda li: F.array(*[F.struct(F.lit(float(q)).alias("quantity"), F.lit(p).alias("unit_price")) for q, p in li])
    rows = F.array(*[F.struct(F.lit(v).alias("vendor_name"), F.lit(n).alias("invoice_number"), F.lit(c).alias("currency"), F.lit(r).alias("tax_rate"), items(li).alias("seed")) for v, n, c, r, li in SYNTHETIC])
    each = buyers.select("buyer_id", "scale", F.inline(rows))
    scaled = F.transform("seed", lambda i: F.struct((i["quantity"] * F.col("scale")).alias("quantity"), i["unit_price"].alias("unit_price")))
    return summed_invoices(each.withColumn("line_items", scaled).drop("seed"))
