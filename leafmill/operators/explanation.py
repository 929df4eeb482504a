"""Why a field has its confidence: ordered signals for each field, a summary, and one for the invoice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.plan import bound, once
from leafmill.functions.text import ground_key, is_known_currency, parse_date
from leafmill.operators.confidence import GROUNDING_CAP, KEY_FIELDS, math_checks_out
from leafmill.operators.schemas import FIELDS

SIGNAL = "struct<label:string,description:string,delta:double,category:string>"
HIGH, MODERATE = 0.85, 0.65


def _signal(label: str, description: Column | str, delta: Column | float, category: str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(label).alias("label"), lit(description).alias("description"), lit(delta).cast("double").alias("delta"), F.lit(category).alias("category"))


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def explain_field(name: str, original: Column, final: Column, haystack: Column, math: Column, matched: Column, history: bool) -> Column:
    """One field's struct: values, confidences, grounded, signals and summary."""
    value, conf = original["value"], original["confidence"]
    there, text = F.coalesce(value != "", F.lit(False)), F.coalesce(value, F.lit("None"))
    found = bound(ground_key(value), lambda key: F.coalesce((key != "") & F.contains(haystack, key), F.lit(False)))

    def with_grounded(grounded: Column) -> Column:
        return bound(signals_of(grounded), lambda after: told(grounded, after))

    cap = F.least(F.lit(0.0), GROUNDING_CAP - conf)
    signals = []
    word = lambda gap: F.when(gap > 0, "boosted").otherwise("penalised")
    if name in ("invoice_date", "due_date"):
        signals.append(F.when(there & parse_date(value).isNotNull(), _signal("date_parseable", _said("'", text, "' is a valid parseable date (+0.10)."), 0.10, "heuristic")))
    if name == "currency":
        signals.append(F.when(there & is_known_currency(value), _signal("known_iso4217_currency", _said("'", text, "' is a recognised ISO-4217 currency code (+0.10)."), 0.10, "heuristic")))
    if name in ("subtotal", "tax_amount", "total_amount"):
        good = _signal("math_subtotal_plus_tax_equals_total", "subtotal + tax_amount ≈ total_amount (within 1% tolerance) (+0.20).", 0.20, "heuristic")
        bad = _signal("math_contradiction", f"subtotal + tax_amount ≠ total_amount — at least one amount is wrong. Confidence capped at {GROUNDING_CAP}.", cap, "heuristic")
        signals.append(F.when(math, good).when(~math, bad))
    if name == "vendor_name":
        signals.append(F.when(matched, _signal("vendor_matched", "Vendor matched an existing canonical record (+0.10).", 0.10, "heuristic")))
    lost = _signal("not_grounded_in_source", _said("Value '", text, f"' was not found in the source text — possible hallucination. Confidence capped at {GROUNDING_CAP}."), cap, "grounding")
    seen = _signal("grounded_in_source", _said("Value '", text, "' was found verbatim in the source text."), 0.0, "grounding")
    base = _signal("llm_base", _said("LLM reported '", text, F.format_string("' with confidence %.2f.", conf)), 0.0, "llm_base")

    def signals_of(grounded: Column) -> Column:
        placed = F.when(grounded, seen).when(~grounded & (conf > GROUNDING_CAP), lost)
        after = F.array_compact(F.array(*[s.cast(SIGNAL) for s in (*signals, placed)]))
        return bound(after, with_history) if history else after

    def with_history(after: Column) -> Column:
        def added(gap: Column) -> Column:
            extra = _signal("vendor_intelligence", _said("Vendor history ", word(gap), F.format_string(" this field by %+.2f.", gap)), F.round(gap, 4), "vendor_intelligence")
            shows = (F.abs(final["confidence"] - conf) > 1e-6) & (F.abs(gap) > 0.01)
            return F.when(shows, F.array_append(after, extra.cast(SIGNAL))).otherwise(after)

        return bound(final["confidence"] - conf - F.aggregate(after, F.lit(0.0), lambda a, s: a + s["delta"]), added)

    def told(grounded: Column, after: Column) -> Column:
        labels = F.array_join(F.filter(F.transform(after, lambda s: s["label"]), lambda s: s != "grounded_in_source"), ", ")
        return F.struct(
            F.lit(name).alias("field_name"),
            value.alias("llm_value"),
            F.round(conf, 4).alias("llm_confidence"),
            F.round(final["confidence"], 4).alias("final_confidence"),
            grounded.alias("grounded"),
            F.concat(F.array(base.cast(SIGNAL)), after).alias("signals"),
            bound(labels, summary).alias("summary"),
        )

    def summary(labels: Column) -> Column:
        c = F.format_string("%.2f", final["confidence"])
        return (
            F.when(labels == "", _said("Score unchanged at ", c, "."))
            .when(final["confidence"] >= HIGH, _said("High confidence (", c, "). Signals: ", labels, "."))
            .when(final["confidence"] >= MODERATE, _said("Moderate confidence (", c, "). Signals: ", labels, "."))
            .otherwise(_said("Low confidence (", c, ") — review required. Signals: ", labels, "."))
        )

    return bound(F.when((haystack != "") & there, found), with_grounded)


def explain(records: DataFrame, original_col: str = "original", final_col: str = "extracted", history: bool = False) -> DataFrame:
    """Adds ``explanation``: fields, math_check, math_delta, grounding_applied, overall_score and summary."""
    get = lambda n: F.col(f"{original_col}.{n}.value")
    placed = once(records, {"_hay": ground_key(F.coalesce(F.col("raw_text"), F.lit(""))), "_math": math_checks_out(get)})
    fields = F.array(*[F.col(f"_x_{n}") for n in FIELDS])
    each = {f"_x_{n}": explain_field(n, F.col(f"{original_col}.{n}"), F.col(f"{final_col}.{n}"), F.col("_hay"), F.col("_math"), F.col("vendor_matched"), history) for n in FIELDS}
    out = once(once(placed, each), {"_fields": fields}).drop(*each)
    keyed = F.filter("_fields", lambda f: f["field_name"].isin(*KEY_FIELDS))
    overall = F.round(F.aggregate(keyed, F.lit(0.0), lambda a, f: a + f["final_confidence"]) / len(KEY_FIELDS), 4)
    out = once(out, {"_overall": overall, "_lost": F.exists("_fields", lambda f: F.exists(f["signals"], lambda s: s["label"] == "not_grounded_in_source"))})
    percent = F.format_string("%.0f%%", F.col("_overall") * 100)
    summary = F.concat(
        F.when(F.col("_overall") >= HIGH, _said("Extraction quality is high (overall ", percent, ")."))
        .when(F.col("_overall") >= MODERATE, _said("Extraction quality is moderate (overall ", percent, "). Some fields may require review."))
        .otherwise(_said("Extraction quality is low (overall ", percent, "). Human review is strongly recommended.")),
        F.when(~F.col("_math"), " ⚠ Financial totals do not add up.").otherwise(""),
        F.when(F.col("_lost"), " ⚠ Some values could not be grounded in the source document.").otherwise(""),
    )
    delta = F.when(F.col("_math"), 0.20).when(~F.col("_math"), -0.3).otherwise(0.0)
    made = F.struct(F.col("_fields").alias("fields"), F.col("_math").alias("math_check"), delta.alias("math_delta"), F.col("_lost").alias("grounding_applied"), F.lit(history).alias("vendor_intelligence_applied"), F.col("_overall").alias("overall_score"), summary.alias("summary"))
    return out.withColumn("explanation", made).drop("_hay", "_math", "_fields", "_overall", "_lost")
