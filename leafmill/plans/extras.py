"""Smaller operators: costs, provider errors, masks, templates, seeds, product lists, file filters, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.amounts import display_amount
from leafmill.operators import reports as R
from leafmill.operators import vendors as N
from leafmill.operators.extraction import extract
from leafmill.plans.registry import query
from leafmill.plans.sql import VIEWS, with_views
from leafmill.sources import domain as D
from leafmill.sources.domain import table
from leafmill.sources.seeds import SEED_VENDORS, SYNTHETIC, seed_vendors, synthetic_for
from leafmill.sources.sinks import notices


@query("q_llm_cost", "SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN event_id / 1000.0::DOUBLE * 0.00015 + user_id / 1000.0::DOUBLE * 0.0006 WHEN 1 THEN event_id / 1000.0::DOUBLE * 0.0025 + user_id / 1000.0::DOUBLE * 0.01 ELSE 0 END, 9)::DOUBLE AS cost FROM events")
def q_llm_cost(spark, sf):
    k = F.col("event_id") % 3
    model = F.when(k == 0, "gpt-4o-mini").when(k == 1, "gpt-4o").otherwise("other")
    return table(spark, sf, "events").select("event_id", F.round(T.llm_cost(F.col("event_id"), F.col("user_id"), model), 9).alias("cost"))


@query("q_provider_error", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Invalid API key' WHEN 1 THEN 'Model not found' WHEN 2 THEN 'Quota exceeded' WHEN 3 THEN 'Rate limited' WHEN 4 THEN 'Network timeout' ELSE 'odd' END AS said FROM events")
def q_provider_error(spark, sf):
    k = F.col("event_id") % 6
    status = F.when(k == 0, 401).when(k == 1, 404).when(k.isin(2, 3), 429)
    message = F.when(k == 2, "Quota is used up").when(k == 4, "it timed out").otherwise("odd")
    return table(spark, sf, "events").select("event_id", T.provider_error(status, F.lit("ApiError"), message).alias("said"))


@query("q_first_reasons", with_views("SELECT id, CASE WHEN id % 6 <= 3 THEN CAST(id % 6 AS VARCHAR) || ' shown' ELSE '3 shown, ' || (id % 6 - 3) || ' more' END AS said FROM inv"))
def q_first_reasons(spark, sf):
    n = (F.col("id") % 6).cast("int")
    reasons = F.array_repeat(F.lit("r"), n)
    shown = T.first_reasons(reasons)
    said = F.when(F.size(shown) > 3, F.concat(F.lit("3 shown, "), F.element_at(shown, -1))).otherwise(F.concat(F.size(shown).cast("string"), F.lit(" shown")))
    return D.invoices(spark, sf).select("id", said.alias("said"))


@query("q_mask_secrets", "SELECT c_custkey, c_custkey % 2 = 0 AS has_key, CASE WHEN c_custkey % 2 = 0 THEN 'has_saved_api_key,model' ELSE 'has_saved_api_key,model' END AS keys FROM customer")
def q_mask_secrets(spark, sf):
    p = F.create_map(F.lit("model"), F.lit("m"), F.lit("encrypted_api_key"), F.when(F.col("c_custkey") % 2 == 0, "secret").otherwise(""))
    m = R.mask_secrets(p)
    return table(spark, sf, "customer").select("c_custkey", (F.element_at(m, "has_saved_api_key") == "true").alias("has_key"), F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"))


@query("q_template_apply", "SELECT doc_id, sha256(CASE WHEN contains(lower(text), 'apache license') THEN '--- VENDOR TEMPLATE DETECTED: Apache License ---' || chr(10) || 'lines: 3' || chr(10) || chr(10) || text ELSE text END) AS digest FROM documents")
def q_template_apply(spark, sf):
    t = spark.createDataFrame([("w", 1, "Apache License", True)], "workspace_id string, template_id int, fingerprint string, is_active boolean")
    d = N.match_templates(table(spark, sf, "documents").select("doc_id", F.lit("w").alias("workspace_id"), F.col("text").alias("raw_text")), t)
    return d.select("doc_id", F.sha2(N.apply_template(F.col("raw_text"), F.col("fingerprint"), F.lit("lines: 3")), 256).alias("digest"))


@query("q_display_amount", with_views("SELECT id, CASE WHEN currency = 'EUR' THEN '€' ELSE '$' END || format('{:,.2f}', CAST(total_amount AS DECIMAL(18,2))::DOUBLE) AS shown FROM inv"))
def q_display_amount(spark, sf):
    symbol = F.when(F.col("currency") == "EUR", "€").otherwise("$")
    return D.invoices(spark, sf).select("id", display_amount(F.col("total_amount").cast("decimal(18,2)"), symbol).alias("shown"))


_SEED_NAMES = ", ".join(f"('{n}', {len(a)})" for n, a, _, _ in SEED_VENDORS)
_SEED_KNOWN = "CASE vendor_id % 7 WHEN 0 THEN 'Acme Corp' WHEN 1 THEN 'Delta Solutions' ELSE canonical_name END"


@query("q_seed_vendors", with_views(f"SELECT w.workspace_id, s.name AS canonical_name, s.n AS n_aliases FROM (SELECT DISTINCT workspace_id FROM vend) w CROSS JOIN (VALUES {_SEED_NAMES}) s(name, n) WHERE NOT EXISTS (SELECT 1 FROM vend v WHERE v.workspace_id = w.workspace_id AND v.vendor_id % 3 = 0 AND {_SEED_KNOWN} = s.name)"))
def q_seed_vendors(spark, sf):
    """Tenants of whom some have vendors of the seed already."""
    k = F.col("vendor_id") % 7
    v = D.vendors(spark, sf)
    known = v.filter("vendor_id % 3 = 0").select("workspace_id", F.when(k == 0, "Acme Corp").when(k == 1, "Delta Solutions").otherwise(F.col("canonical_name")).alias("canonical_name"))
    return seed_vendors(v, known).select("workspace_id", "canonical_name", F.size("aliases").cast("int").alias("n_aliases"))


_SYNTHETIC_SQL = " UNION ALL ".join(f"SELECT c_custkey AS buyer_id, '{v}' AS vendor_name, '{n}' AS invoice_number, CAST({' + '.join(f'{q} * (1 + c_custkey % 5) * {p!r}' for q, p in li)} AS DECIMAL(18,2)) AS subtotal, {r!r} AS rate FROM customer" for v, n, _, r, li in SYNTHETIC)


@query("q_synthetic_invoices", f"SELECT buyer_id, vendor_name, invoice_number, subtotal, CAST(subtotal * rate AS DECIMAL(18,2)) AS tax_amount, CAST(subtotal + CAST(subtotal * rate AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS total_amount FROM ({_SYNTHETIC_SQL})")
def q_synthetic_invoices(spark, sf):
    """The synthetic invoices for every customer, in a size of its own."""
    buyers = table(spark, sf, "customer").select(F.col("c_custkey").alias("buyer_id"), (1 + F.col("c_custkey") % 5).cast("double").alias("scale"))
    return synthetic_for(buyers).select("buyer_id", "vendor_name", "invoice_number", "subtotal", "tax_amount", "total_amount")


# The kept list with the new one: distinct products by falling count, then by first place, twenty at most.
_KEEP = "list_transform(list_sort(list_transform(list_filter({b}, lambda x, i: list_position({b}, x) = i), lambda x: {{'n': -len(list_filter({b}, lambda y: y = x)), 'i': list_position({b}, x), 'p': x}}))[1:20], lambda s: s.p)"
_BOUGHT = "per AS (SELECT l_suppkey AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY invoice_id) AS n, list_sort(list(description)) AS p FROM lin GROUP BY l_suppkey, invoice_id)"


@query("q_products_fold", f"WITH RECURSIVE {VIEWS}, {_BOUGHT}, kept AS (SELECT v, n, {_KEEP.format(b='p')} AS k FROM per WHERE n = 1 UNION ALL SELECT t.v, t.n, {_KEEP.format(b='t.b')} FROM (SELECT per.v, per.n, kept.k || per.p AS b FROM kept JOIN per ON per.v = kept.v AND per.n = kept.n + 1) t) SELECT v AS vendor_id, array_to_string(arg_max(k, n), '|') AS products FROM kept GROUP BY 1")
def q_products_fold(spark, sf):
    lines = D.lines(spark, sf).select(F.col("l_suppkey").alias("vendor_id"), F.col("invoice_id").alias("ord"), F.col("description").alias("product"))
    return N.products_by_order(lines).select("vendor_id", F.array_join("products", "|").alias("products"))


@query("q_file_filter", with_views("SELECT filename, file_size_bytes, min(id) AS id FROM docs WHERE file_size_bytes <= 5000 GROUP BY 1, 2"))
def q_file_filter(spark, sf):
    from leafmill.sources.files import ALLOWED_TYPES, mime_type

    d = D.documents(spark, sf).filter(mime_type(F.col("filename")).isin(*ALLOWED_TYPES) & (F.col("file_size_bytes") <= 5000))
    return d.groupBy("filename", "file_size_bytes").agg(F.min("id").alias("id"))


@query("q_notices", with_views("SELECT id, '{\"document_id\":\"' || id || '\",\"status\":\"' || status || '\",\"needs_review\":' || (status = 'needs_review') || ',\"review_reasons\":[]}' AS body FROM docs WHERE status IN ('complete', 'needs_review')"))
def q_notices(spark, sf):
    d = D.documents(spark, sf).withColumns({"needs_review": F.col("status") == "needs_review", "review_reasons": F.array().cast("array<string>")})
    return notices(d)


@query("q_extract", with_views("SELECT id, invoice_number, currency, CAST(total_amount AS VARCHAR) AS total FROM inv"))
def q_extract(spark, sf):
    i = D.invoices(spark, sf)
    text = F.concat_ws("\n", F.lit("INVOICE"), F.concat(F.lit("Invoice No: "), F.col("invoice_number")), F.concat(F.lit("Currency: "), F.col("currency")), F.concat(F.lit("Grand total: "), F.col("total_amount").cast("string")))
    e = extract(i.select(F.col("id").cast("string").alias("id"), text.alias("raw_text")))
    v = lambda f: F.col(f"extracted.{f}.value")
    return e.select(F.col("id").cast("long").alias("id"), v("invoice_number").alias("invoice_number"), v("currency").alias("currency"), v("total_amount").alias("total"))


_WORD_KEY = "lower(regexp_replace(coalesce(w[{i}], ''), '\\s+', '', 'g'))"
_LAST_WORD = " ".join(f"WHEN {_WORD_KEY.format(i=i)} <> '' THEN {i}" for i in (3, 2, 1))


@query("q_bbox_grounding", f"SELECT doc_id, '0,0,' || (10 * j) || ',10' AS box FROM (SELECT doc_id, CASE {_LAST_WORD} END AS j FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))")
def q_bbox_grounding(spark, sf):
    from leafmill.operators.confidence import grounding_box

    word = lambda t, i: F.struct(t.alias("text"), F.array(10.0 * i, F.lit(0.0), 10.0 * i + 10, F.lit(10.0)).alias("bbox"), F.lit(0).alias("page"), F.lit(1.0).alias("confidence"))
    words = F.split("text", " ")
    pages = F.array(F.struct(F.lit(0).alias("page_num"), F.lit("").alias("text"), F.transform(words, word).alias("words")))
    d = table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(words, 1, 3), " ").alias("said"), pages.alias("pages"))
    out = d.select("doc_id", grounding_box(F.col("said"), F.col("pages"))["bbox"].alias("b"))
    return out.select("doc_id", F.array_join(F.transform("b", lambda x: x.cast("int").cast("string")), ",").alias("box"))
