"""The 14 business rules of an invoice, each a builder of one result column.

Every rule runs on every invoice and none raises: what cannot be judged is skipped.  More rules join by
``register``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.amounts import AMOUNT, parse_amount
from leafmill.functions.plan import bound, once
from leafmill.functions.text import blank, is_iso_4217, is_payment_terms, parse_date
from leafmill.operators.schemas import MANDATORY, RESULT

MAX_AMOUNT = 999_999_999_999
Get = Callable[[str], Column]
Rule = Callable[[Get], Column]
RULES: dict[str, Rule] = {}


def register(name: str) -> Callable[[Rule], Rule]:
    def add(f: Rule) -> Rule:
        RULES[name] = f
        return f

    return add


class Parsed:
    """Values of a record by name; those parsed before are taken from their columns."""

    def __init__(self, get: Get, amounts: dict[str, Column], days: dict[str, Column]):
        self.get, self.amounts, self.days, self.used = get, amounts, days, set()

    def __call__(self, name: str) -> Column:
        return self.get(name)


def amount(get: Get, name: str) -> Column:
    if name not in getattr(get, "amounts", {}):
        return parse_amount(get(name))
    get.used.add(f"_amount_{name}")
    return get.amounts[name]


def day_of(get: Get, name: str) -> Column:
    if name not in getattr(get, "days", {}):
        return parse_date(get(name))
    get.used.add(f"_day_{name}")
    return get.days[name]


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def plain(amount: Column) -> Column:
    """A decimal without trailing zeros."""
    s = F.regexp_replace(amount.cast("string"), r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_replace(s, r"\.$", "")


def result(status: str, message: Column | str, impact: Column | float = 0.0, fix: Column | str | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit("").alias("rule_name"), F.lit(status).alias("status"), lit(message).alias("message"), lit(impact).cast("double").alias("confidence_impact"), lit(fix).cast("string").alias("suggested_fix"))


@register("invoice_number_exists")
def _number(get: Get) -> Column:
    return F.when(~blank(get("invoice_number")), result("pass", "Invoice number is present.")).otherwise(result("fail", "Invoice number is missing.", -0.15, "Manually enter the invoice number from the document."))


@register("vendor_exists")
def _vendor(get: Get) -> Column:
    return F.when(~blank(get("vendor_name")), result("pass", "Vendor name is present.")).otherwise(result("fail", "Vendor name is missing.", -0.15, "Identify the vendor from the document header or logo."))


@register("vendor_name_valid")
def _vendor_name(get: Get) -> Column:
    name = F.trim(get("vendor_name"))
    return (
        F.when(blank(get("vendor_name")), result("skip", "Skipped — vendor name is empty (covered by vendor_exists)."))
        .when(F.length(name) < 2, result("fail", text("Vendor name '", name, "' is too short (min 2 chars)."), -0.1, "Verify the full vendor name from the document."))
        .when(name.rlike(r"(?U)^[\d\W]+$"), result("fail", text("Vendor name '", name, "' appears to be garbage (only digits/symbols)."), -0.15, "Re-extract the vendor name — current value is not a valid business name."))
        .otherwise(result("pass", text("Vendor name '", name, "' appears valid.")))
    )


@register("invoice_date_valid")
def _date(get: Get) -> Column:
    raw, day = get("invoice_date"), day_of(get, "invoice_date")
    return (
        F.when(blank(raw), result("fail", "Invoice date is missing.", -0.1, "Enter the invoice date from the document."))
        .when(day.isNull(), result("fail", text("Invoice date '", raw, "' is not a valid date."), -0.1, "Correct the date format (e.g. 2024-01-15)."))
        .otherwise(result("pass", text("Invoice date '", raw, "' is valid (parsed as ", day, ").")))
    )


@register("due_date_after_invoice_date")
def _due(get: Get) -> Column:
    day, due = day_of(get, "invoice_date"), day_of(get, "due_date")
    return (
        F.when(blank(get("invoice_date")) | blank(get("due_date")), result("skip", "Skipped — invoice date or due date missing."))
        .when(day.isNull() | due.isNull(), result("skip", "Skipped — could not parse one or both dates."))
        .when(due >= day, result("pass", text("Due date (", due, ") is on or after invoice date (", day, ").")))
        .otherwise(result("fail", text("Due date (", due, ") is before invoice date (", day, ")."), -0.1, "Verify the due date — it should not precede the invoice date."))
    )


@register("currency_iso_4217")
def _currency(get: Get) -> Column:
    raw = get("currency")
    return (
        F.when(blank(raw), result("fail", "Currency code is missing.", -0.1, "Identify the currency from the document."))
        .when(is_iso_4217(raw), result("pass", text("Currency '", F.upper(F.trim(raw)), "' is a valid ISO 4217 code.")))
        .otherwise(result("fail", text("Currency '", raw, "' is not a recognized ISO 4217 code."), -0.1, text("Replace '", raw, "' with a valid 3-letter ISO 4217 code (e.g. USD, EUR, GBP).")))
    )


@register("decimal_validation")
def _decimals(get: Get) -> Column:
    bad = F.array_join(F.array_compact(F.array(*[F.when(~blank(get(f)) & amount(get, f).isNull(), F.lit(f)) for f in ("subtotal", "tax_amount", "total_amount")])), ", ")
    return F.when(bad == "", result("pass", "All monetary fields are valid decimals.")).otherwise(result("fail", text("Could not parse as decimal: ", bad, "."), -0.1, text("Correct the numeric format for: ", bad, ".")))


@register("tax_non_negative")
def _tax(get: Get) -> Column:
    tax = amount(get, "tax_amount")
    return (
        F.when(blank(get("tax_amount")), result("skip", "Skipped — tax amount is missing."))
        .when(tax.isNull(), result("skip", "Skipped — tax amount is not parseable."))
        .when(tax >= 0, result("pass", text("Tax amount (", plain(tax), ") is non-negative.")))
        .otherwise(result("fail", text("Tax amount (", plain(tax), ") is negative."), -0.1, "Tax amount should be zero or positive. Verify the value."))
    )


@register("total_equals_subtotal_plus_tax")
def _total(get: Get) -> Column:
    sub, tax, total = (amount(get, f) for f in ("subtotal", "tax_amount", "total_amount"))
    expected = (sub + tax).cast(AMOUNT)
    gap = F.abs(expected - total)
    sums = (plain(sub), " + ", plain(tax), " = ", plain(expected))
    return (
        F.when(sub.isNull() | tax.isNull() | total.isNull(), result("skip", "Skipped — one or more amount fields missing or unparseable."))
        .when(total == 0, result("skip", "Skipped — total is zero."))
        .when(gap * 100 <= F.abs(total), result("pass", text("Math checks out: ", *sums, " ≈ ", plain(total), ".")))
        .otherwise(result("fail", text("Math mismatch: ", *sums, ", but total is ", plain(total), " (diff: ", plain(gap), ")."), -0.2, text("Expected total: ", plain(expected), ". Verify subtotal, tax, and total amounts.")))
    )


@register("duplicate_invoice_detection")
def _duplicate(get: Get) -> Column:
    number, other = get("invoice_number"), get("duplicate_of")
    return (
        F.when(blank(number), result("skip", "Skipped — no invoice number to check."))
        .when(other.isNull(), result("pass", text("No duplicate found for invoice '", number, "'.")))
        .otherwise(result("warn", text("Potential duplicate: invoice '", number, "' already exists (document_id=", other, ")."), -0.1, "Review whether this is a genuine duplicate or a different invoice."))
    )


@register("mandatory_fields")
def _mandatory(get: Get) -> Column:
    missing = F.array_compact(F.array(*[F.when(blank(get(f)), F.lit(f)) for f in MANDATORY]))
    names = F.array_join(missing, ", ")
    return F.when(F.size(missing) == 0, result("pass", "All mandatory fields are present.")).otherwise(result("fail", text("Missing mandatory fields: ", names, "."), F.size(missing) * F.lit(-0.05), text("Review the document and fill in: ", names, ".")))


@register("payment_terms_valid")
def _terms(get: Get) -> Column:
    raw = get("payment_terms")
    return (
        F.when(blank(raw), result("skip", "Skipped — payment terms not provided."))
        .when(is_payment_terms(raw), result("pass", text("Payment terms '", F.trim(raw), "' match a known format.")))
        .otherwise(result("warn", text("Payment terms '", F.trim(raw), "' do not match common formats."), -0.05, "Verify payment terms — expected formats: 'Net 30', 'Due on receipt', etc."))
    )


@register("tax_percentage_validation")
def _rate(get: Get) -> Column:
    sub, tax = amount(get, "subtotal"), amount(get, "tax_amount")
    rate = F.when(sub != 0, tax.cast("double") / sub.cast("double") * 100)
    inside = (F.signum(tax) * F.signum(sub) >= 0) & (F.abs(tax) <= F.abs(sub))
    shown = F.format_string("%.2f", rate)
    return (
        F.when(sub.isNull() | tax.isNull(), result("skip", "Skipped — subtotal or tax amount missing."))
        .when(sub == 0, result("skip", "Skipped — subtotal is zero."))
        .when(inside, result("pass", text("Tax rate is ", shown, "% — within valid range.")))
        .otherwise(result("warn", text("Tax rate is ", shown, "% — outside 0–100% range."), -0.05, "Verify tax and subtotal amounts — the implied tax rate is unusual."))
    )


@register("invalid_amount_detection")
def _invalid(get: Get) -> Column:
    def issue(f: str) -> Column:
        x = amount(get, f)
        return F.when(x < 0, text(f, " is negative (", plain(x), ")")).when(x > MAX_AMOUNT, text(f, " exceeds maximum (", plain(x), ")"))

    issues = F.array_join(F.array_compact(F.array(issue("subtotal"), issue("total_amount"))), "; ")
    return F.when(issues == "", result("pass", "All amounts are within valid ranges.")).otherwise(result("fail", text("Invalid amounts detected: ", issues, "."), -0.15, "Review flagged amounts — negative or extremely large values are suspicious."))


def _named(name: str) -> Callable[[Column], Column]:
    return lambda r: r.withField("rule_name", F.lit(name))


def rule_results(get: Get, rules: dict[str, Rule] | None = None) -> Column:
    """array<struct> of all results in the registry's order."""
    return F.array(*[bound(f(get).cast(RESULT), _named(name)) for name, f in (rules or RULES).items()])


def report(results: Column) -> Column:
    """Results with their tallies."""
    tally = lambda s: F.size(F.filter(results, lambda r: r["status"] == s)).alias({"pass": "passed", "fail": "failed", "warn": "warnings", "skip": "skipped"}[s])
    impact = F.aggregate(results, F.lit(0.0), lambda a, r: a + r["confidence_impact"])
    return F.struct(results.alias("results"), *[tally(s) for s in ("pass", "fail", "warn", "skip")], (F.size(F.filter(results, lambda r: r["status"] == "fail")) == 0).alias("is_valid"), impact.alias("total_confidence_impact"))


def validate(records: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Adds ``validation_report`` to records with ``extracted`` and ``duplicate_of``."""
    get = lambda f: F.col(f) if f == "duplicate_of" else F.col(f"extracted.{f}.value")
    amounts, days = ("subtotal", "tax_amount", "total_amount"), ("invoice_date", "due_date")
    parsed = Parsed(get, {f: F.col(f"_amount_{f}") for f in amounts}, {f: F.col(f"_day_{f}") for f in days})
    results = rule_results(parsed, rules)
    # What several rules use is parsed once, before them.
    before = {f"_amount_{f}": parse_amount(get(f)) for f in amounts} | {f"_day_{f}": parse_date(get(f)) for f in days}
    before = {k: c for k, c in before.items() if k in parsed.used}
    judged = once(once(records, before) if before else records, {"_results": results})
    return judged.withColumn("validation_report", report(F.col("_results"))).drop("_results", *before)


def find_duplicates(invoices: DataFrame, by_tenant: bool = True) -> DataFrame:
    """Adds ``duplicate_of``: a document of the same number, one of the same vendor name if there is one.

    Counting stands in for a self join: for each number, and each number with vendor, the two smallest
    document ids say for every row which other document there is.
    """
    scope = ["workspace_id"] if by_tenant else []
    name = F.lower(F.trim("vendor_name"))
    docs = invoices.withColumn("_vendor", F.coalesce(name, F.lit("")))
    small = docs.filter("invoice_number is not null").groupBy(*scope, "invoice_number", "_vendor").agg(F.min("document_id").alias("a"), F.max("document_id").alias("z"))
    by_number = small.groupBy(*scope, "invoice_number").agg(F.min("a").alias("na"), F.max("z").alias("nz"))
    other = lambda a, z: F.when(F.col(a) != F.col("document_id"), F.col(a)).when(F.col(z) != F.col("document_id"), F.col(z))
    out = docs.join(small, [*scope, "invoice_number", "_vendor"], "left").join(by_number, [*scope, "invoice_number"], "left")
    named = F.when(F.col("_vendor") != "", other("a", "z"))
    return out.withColumn("duplicate_of", F.coalesce(named, other("na", "nz"))).drop("_vendor", "a", "z", "na", "nz")
