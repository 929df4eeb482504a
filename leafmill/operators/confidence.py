"""Confidence: grounding of values in the text, seven weighted signals, and the legacy heuristics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.amounts import parse_amount
from leafmill.functions.plan import bound, once
from leafmill.functions.text import blank, ground_key, is_known_currency, parse_date
from leafmill.operators.schemas import FIELDS, LOW_CONFIDENCE

GROUNDING_CAP = 0.5
WINDOW = 14
KEY_FIELDS = ("invoice_number", "invoice_date", "vendor_name", "total_amount", "currency")


# Grounding.


def grounding_cap(field: Column, haystack: Column) -> Column:
    """The field with its confidence capped if its value is not in the text; ``haystack`` is a ground key."""
    needle = ground_key(field["value"])
    missing = (haystack != "") & ~blank(field["value"]) & ~F.contains(haystack, needle) & (field["confidence"] > GROUNDING_CAP)
    return F.when(missing, field.withField("confidence", F.lit(GROUNDING_CAP))).otherwise(field)


def grounding_box(value: Column, pages: Column) -> Column:
    """struct<page,bbox> of the words that hold the value: on the first page with it, from the first start
    with a window of up to 14 words that contains it."""

    def boxes(p: Column, needle: Column) -> Column:
        # The keys are bound to a variable, so that they are made once a page.
        return bound(F.transform(p["words"], lambda w: ground_key(w["text"])), lambda keys: with_keys(p, keys, needle))

    def with_keys(p: Column, keys: Column, needle: Column) -> Column:
        n = F.size(p["words"])

        def holds(i: Column, words: Column) -> Column:
            return F.contains(F.array_join(F.slice(keys, i + 1, words), ""), needle)

        def from_start(i: Column) -> Column:
            hit = F.filter(F.sequence(i + 1, F.least(i + WINDOW, n)), lambda j: holds(i, j - i))
            words = F.filter(F.slice(p["words"], i + 1, F.get(hit, F.lit(0)) - i), lambda w: w["bbox"].isNotNull())
            return bound(F.struct(hit.alias("hit"), words.alias("words")), box)

        def box(x: Column) -> Column:
            side = lambda k, f: f(F.transform(x["words"], lambda w: w["bbox"][k]))
            around = F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))
            return F.when((F.size(x["hit"]) > 0) & (F.size(x["words"]) > 0), around)

        def from_first(first: Column) -> Column:
            # Starts before ``first`` are too far from the first place of the value; most pages need no other one.
            others = F.filter(F.sequence(first + 1, n - 1), lambda i: holds(i, F.lit(WINDOW)))
            later = F.get(F.filter(F.transform(others, from_start), lambda b: b.isNotNull()), F.lit(0))
            return F.coalesce(from_start(first), F.when(first + 1 < n, later))

        def with_end(end: Column) -> Column:
            size = lambda k: F.coalesce(F.length(k), F.lit(0))
            step = lambda s, k: F.struct((s["chars"] + size(k)).alias("chars"), (s["word"] + F.when(s["chars"] + size(k) < end, 1).otherwise(0)).alias("word"))
            last = F.aggregate(keys, F.struct(F.lit(0).alias("chars"), F.lit(0).alias("word")), step, lambda s: s["word"])
            return F.struct(p["page_num"].alias("page"), bound(F.greatest(last - (WINDOW - 1), F.lit(0)), from_first).alias("bbox"))

        # The characters up to the end of the value where it first is.
        return bound(F.instr(F.array_join(keys, ""), needle), lambda at: F.when((n > 0) & (at > 0), with_end(at - 1 + F.length(needle))))

    def with_needle(needle: Column) -> Column:
        found = F.filter(F.transform(pages, lambda p: boxes(p, needle)), lambda b: b.isNotNull() & b["bbox"].isNotNull())
        return F.get(found, F.lit(0))

    return F.when(~blank(value), bound(ground_key(value), with_needle))


def ground(records: DataFrame, with_boxes: bool = True) -> DataFrame:
    """Caps and places all scalar fields of ``extracted``."""
    hay = ground_key(F.coalesce(F.col("raw_text"), F.lit("")))

    def one(name: str) -> Column:
        field = grounding_cap(F.col(f"extracted.{name}"), F.col("_hay"))
        if with_boxes:
            box = grounding_box(field["value"], F.coalesce(F.col("pages"), F.array()))
            field = field.withField("page", F.coalesce(box["page"], field["page"])).withField("bbox", F.coalesce(box["bbox"], field["bbox"]))
        return field

    e = F.col("extracted")
    for name in FIELDS:
        e = e.withField(name, one(name))
    return once(records, {"_hay": hay}).withColumn("extracted", F.when(F.col("_hay") == "", F.col("extracted")).otherwise(e)).drop("_hay")


def math_checks_out(get: Callable[[str], Column]) -> Column:
    """True or false; null if an amount is missing or the total is zero."""
    def holds(x: Column) -> Column:
        s, t, total = x["s"], x["t"], x["total"]
        return F.when(s.isNotNull() & t.isNotNull() & total.isNotNull() & (total != 0), F.abs(s + t - total) * 100 <= F.abs(total))

    return bound(_sums(get), holds)


def _sums(get: Callable[[str], Column]) -> Column:
    """The amounts s, t and total of a record."""
    return F.struct(*[parse_amount(get(f)).alias(a) for a, f in (("s", "subtotal"), ("t", "tax_amount"), ("total", "total_amount"))])


# Signals.

Signal = Callable[[], Column]
SIGNALS: dict[str, tuple[float, Signal]] = {}


def signal(name: str, weight: float) -> Callable[[Signal], Signal]:
    def add(f: Signal) -> Signal:
        SIGNALS[name] = (weight, f)
        return f

    return add


def _value(name: str) -> Column:
    return F.col(f"extracted.{name}.value")


@signal("ocr", 0.15)
def _ocr() -> Column:
    return F.lit(0.8)


@signal("llm", 0.25)
def _llm() -> Column:
    line = lambda i: F.array(*[F.coalesce(i[k]["confidence"], F.lit(0.0)) for k in ("description", "quantity", "unit_price", "total")])
    all_ = F.concat(F.array(*[F.coalesce(F.col(f"extracted.{f}.confidence"), F.lit(0.0)) for f in FIELDS]), F.flatten(F.transform(F.coalesce(F.col("extracted.line_items"), F.array()), line)))
    mean = F.aggregate(all_, F.lit(0.0), lambda s, x: s + x) / F.size(all_)
    return F.when(F.col("extracted").isNull(), 0.0).otherwise(mean)


@signal("validation", 0.20)
def _validation() -> Column:
    passed, judged = F.col("_passed"), F.col("_judged")
    return F.coalesce(F.try_divide(passed.cast("double"), judged.cast("double")), F.lit(0.5))


@signal("vendor", 0.10)
def _vendor() -> Column:
    return F.when(F.col("vendor_matched"), 1.0).otherwise(0.5)


@signal("math", 0.15)
def _math() -> Column:
    def near(x: Column) -> Column:
        s, t, total = x["s"], x["t"], x["total"]
        gap = F.abs(s + t - total)
        return F.when(s.isNull() | t.isNull() | total.isNull(), 0.5).when(gap == 0, 1.0).when(gap * 100 <= F.abs(total), 0.8).otherwise(0.3)

    return bound(_sums(_value), near)


@signal("completeness", 0.10)
def _completeness() -> Column:
    filled = reduce(lambda a, b: a + b, [F.when(blank(_value(f)), 0).otherwise(1) for f in FIELDS])
    return F.when(F.col("extracted").isNull(), 0.0).otherwise(filled / F.lit(float(len(FIELDS))))


@signal("quality", 0.05)
def _quality() -> Column:
    n = F.length(F.coalesce(F.col("raw_text"), F.lit("")))
    return F.when(n < 50, 0.2).when(n < 200, 0.5).when(n > 20000, 0.4).when(n > 10000, 0.6).otherwise(0.9)


def score(records: DataFrame, signals: dict[str, tuple[float, Signal]] | None = None, report_col: str | None = None) -> DataFrame:
    """Adds ``signals``, ``overall`` and ``low_confidence``.

    Validation scores 0.5 unless ``report_col`` names a report that was made before.
    """
    signals = signals or SIGNALS
    if report_col:
        r = F.col(report_col)
        records = records.withColumns({"_passed": r["passed"], "_judged": r["passed"] + r["failed"] + r["warnings"]})
    else:
        records = records.withColumns({"_passed": F.lit(0), "_judged": F.lit(0)})
    each = [F.struct(F.lit(n).alias("name"), f().cast("double").alias("score"), F.lit(w).alias("weight")) for n, (w, f) in signals.items()]
    total = lambda k: F.aggregate(F.col("signals"), F.lit(0.0), k)
    weighted, weights = total(lambda a, s: a + s["score"] * s["weight"]), total(lambda a, s: a + s["weight"])
    out = once(records, {"signals": F.array(*each)}).withColumn("overall", F.when(weights > 0, weighted / weights).otherwise(0.0))
    return out.withColumn("low_confidence", F.col("overall") < LOW_CONFIDENCE).drop("_passed", "_judged")


def breakdown_map(signals: Column, overall: Column) -> Column:
    """map<string,double> of the overall score and every signal, rounded to two places."""
    return F.map_from_entries(F.concat(F.array(F.struct(F.lit("overall"), F.round(overall, 2))), F.transform(signals, lambda s: F.struct(s["name"], F.round(s["score"], 2)))))


# The older scoring, kept for those who call it.


def legacy_scores(records: DataFrame) -> DataFrame:
    """Heuristic raises, then the grounding cap, on ``extracted``; adds ``legacy_reasons``."""
    records, math = once(records, {"_math": math_checks_out(_value)}), F.col("_math")

    def raised(name: str) -> Column:
        f = F.col(f"extracted.{name}")
        plus = lambda d: F.least(F.lit(1.0), f["confidence"] + d)
        c = f["confidence"]
        if name in ("invoice_date", "due_date"):
            c = F.when(parse_date(f["value"]).isNotNull(), plus(0.1)).otherwise(c)
        elif name == "currency":
            c = F.when(is_known_currency(f["value"]), plus(0.1)).otherwise(c)
        elif name in ("subtotal", "tax_amount", "total_amount"):
            c = F.when(math, plus(0.2)).when(~math, F.least(F.lit(GROUNDING_CAP), c)).otherwise(c)
        elif name == "vendor_name":
            c = F.when(F.col("vendor_matched"), plus(0.1)).otherwise(c)
        return f.withField("confidence", c)

    e = F.col("extracted")
    for name in FIELDS:
        e = e.withField(name, raised(name))
    out = ground(records.withColumn("extracted", e), with_boxes=False)
    reason = lambda n: F.when(F.col(f"extracted.{n}.confidence") < LOW_CONFIDENCE, F.format_string(f"{n}: confidence %.2f < {LOW_CONFIDENCE}", F.col(f"extracted.{n}.confidence")))
    return out.withColumn("legacy_reasons", F.array_compact(F.array(*[reason(n) for n in KEY_FIELDS]))).drop("_math")


def merge_review(records: DataFrame) -> DataFrame:
    """``needs_review`` and ``review_reasons`` of canonical reasons, low confidence and line errors, in this order."""
    low = F.when(F.col("low_confidence"), F.array(F.format_string("Confidence score %.2f < 0.75", F.col("overall")))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(F.coalesce(F.col("review_reasons"), F.array().cast("array<string>")), low, F.coalesce(F.col("math_errors"), F.array().cast("array<string>")))
    need = F.coalesce(F.col("needs_review"), F.lit(False)) | F.col("low_confidence") | (F.size("math_errors") > 0)
    return records.withColumns({"review_reasons": reasons, "needs_review": need})
