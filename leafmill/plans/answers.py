"""Providers, answers in many shapes, the chain of line items, templates, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions.dates import free_date
from leafmill.functions.text import normalize_currency
from leafmill.operators import lineitems as L
from leafmill.operators import vendors as N
from leafmill.operators.extraction import parse_answers
from leafmill.operators.providers import ModelRetired, Service, ask_in_order
from leafmill.operators.schemas import LINE
from leafmill.plans.records import _FOLD, _LINES, _OK, items
from leafmill.plans.registry import query
from leafmill.plans.sql import FIELD_VALUES, VIEWS, confidence, with_views
from leafmill.sources import domain as D
from leafmill.sources.domain import table
from leafmill.sources.files import classify_pages, unseen

_HOURS = 6


def _services() -> tuple[Service, ...]:
    """Two providers that work at some hours only, the first with a model that is retired on every other day, and one that always works."""
    first = lambda at: int(at) // 3600 % 3 != 0
    second = lambda at: int(at) // 1800 % 4 != 1

    def ask(name, works, retired):
        def run(model, text, at):
            if not works(at):
                raise RuntimeError(f"{name} is down")
            if model == retired and int(at) // 86400 % 2 == 0:
                raise ModelRetired(model)
            return f"{model}:{text}"

        return run

    return (
        Service("first", ("first-1", "first-2"), first, ask("first", first, "first-1")),
        Service("second", ("second-1",), second, ask("second", second, None)),
        Service("local", ("local-1",), lambda at: True, ask("local", lambda at: True, None)),
    )


_WORKS = "CASE {p} WHEN 'first' THEN {t} // 3600 % 3 <> 0 WHEN 'second' THEN {t} // 1800 % 4 <> 1 ELSE true END"
_CHOICE = f"""
WITH RECURSIVE c AS MATERIALIZED (SELECT user_id % 8 AS caller, event_id, event_type, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS n,
  CASE WHEN epoch_us(ts) // 1000000 // 3600 % 3 <> 0 THEN 'first' WHEN epoch_us(ts) // 1000000 // 1800 % 4 <> 1 THEN 'second' ELSE 'local' END AS best FROM events),
r AS (SELECT caller, n, event_id, event_type, us AS since, s, best AS provider, best || '-1' AS model0 , CASE WHEN best = 'first' AND s // 86400 % 2 = 0 THEN 'first-2' ELSE best || '-1' END AS model FROM c WHERE n = 1
  UNION ALL SELECT caller, n, event_id, event_type, since, s, provider, model0, CASE WHEN {_WORKS.format(p='provider', t='s')} AND model0 = 'first-1' AND s // 86400 % 2 = 0 THEN 'first-2' ELSE model0 END
  FROM (SELECT c.caller, c.n, c.event_id, c.event_type, c.s, CASE WHEN c.us - r.since > {_HOURS * 3600 * 1_000_000} THEN c.us ELSE r.since END AS since, CASE WHEN c.us - r.since > {_HOURS * 3600 * 1_000_000} THEN c.best ELSE r.provider END AS provider,
    CASE WHEN c.us - r.since > {_HOURS * 3600 * 1_000_000} THEN c.best || '-1' ELSE r.model END AS model0 FROM r JOIN c ON c.caller = r.caller AND c.n = r.n + 1))
SELECT event_id AS id, provider, model, CASE WHEN {_WORKS.format(p='provider', t='s')} THEN model || ':' || event_type END AS answer, CASE WHEN NOT {_WORKS.format(p='provider', t='s')} THEN provider || ' is down' END AS error FROM r
"""


@query("q_provider_choice", _CHOICE)
def q_provider_choice(spark, sf):
    """A choice holds for six hours here, as a caller's events are half an hour apart."""
    e = table(spark, sf, "events")
    calls = e.select((F.col("user_id") % 8).alias("caller"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("text"))
    return ask_in_order(calls, _services(), _HOURS * 3600)


_FENCE = "```"
_NUMBER = "'{\"value\": \"' || invoice_number || '\", \"confidence\": 0.' || (id % 10) || '}'"
_BODY = f"'{{\"invoice_number\": ' || {_NUMBER} || ', \"currency\": \"' || currency || '\", \"total_amount\": {{\"value\": \"' || CAST(total_amount AS VARCHAR) || '\"}}'"
_ANSWER = f"CASE id % 7 WHEN 0 THEN {_BODY} || '}}' WHEN 1 THEN '{_FENCE}json' || chr(10) || {_BODY} || '}}' || chr(10) || '{_FENCE}' WHEN 2 THEN 'Here it is:' || chr(10) || '{_FENCE}' || {_BODY} || '}}{_FENCE} Good luck' WHEN 3 THEN {_BODY} || ', \"payment_terms\": {{\"value\": \"Net' WHEN 4 THEN {_BODY} || ', \"purch' WHEN 5 THEN 'I cannot read it' ELSE '{{\"currency\": null}}' END"
_FIELD = "CASE WHEN json_type(body, '$.{f}') = 'OBJECT' THEN json_extract_string(body, '$.{f}.value') ELSE json_extract_string(body, '$.{f}') END"


@query("q_answers", with_views(f"SELECT id, {_FIELD.format(f='invoice_number')} AS number, CASE WHEN body IS NULL THEN NULL WHEN json_extract_string(body, '$.invoice_number') IS NULL THEN 0.0::DOUBLE ELSE json_extract_string(body, '$.invoice_number.confidence')::DOUBLE END AS number_confidence, {_FIELD.format(f='currency')} AS currency, CASE WHEN body IS NULL THEN NULL WHEN json_extract_string(body, '$.currency') IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS currency_confidence, {_FIELD.format(f='total_amount')} AS total FROM (SELECT id, CASE WHEN id % 7 = 5 THEN NULL WHEN id % 7 = 6 THEN '{{\"currency\": null}}' ELSE {_BODY} || '}}' END AS body FROM inv)"))
def q_answers(spark, sf):
    """Plain, fenced, cut and useless answers; a cut one keeps its whole fields."""
    a = D.invoices(spark, sf).select("id", F.expr(_ANSWER.replace("VARCHAR", "STRING").replace("chr(10)", "'\\n'").replace("{{", "{").replace("}}", "}")).alias("answer"))
    e = parse_answers(a, F.col("answer"), "e")
    return e.select("id", F.col("e.invoice_number.value").alias("number"), F.col("e.invoice_number.confidence").alias("number_confidence"), F.col("e.currency.value").alias("currency"), F.col("e.currency.confidence").alias("currency_confidence"), F.col("e.total_amount.value").alias("total"))


@query("q_line_chain", with_views(f"SELECT invoice_id, CAST(count(*) AS INTEGER) AS n, string_agg(row_type, ',' ORDER BY position) AS kinds, CAST(count(*) FILTER (WHERE {_OK}) AS INTEGER) AS holds, CAST(count(*) FILTER (WHERE NOT ({_OK})) AS INTEGER) AS fails FROM ({_LINES}) GROUP BY 1"))
def q_line_chain(spark, sf):
    """The whole chain: rich items are chosen, classified, checked, and their errors told."""
    raw = items(spark, sf).select("invoice_id", F.transform("items", lambda i: i.withField("row_type", F.lit("unknown")).withField("math_valid", F.lit(None).cast("boolean"))).alias("x"))
    docs = raw.select("invoice_id", F.struct(F.lit(None).cast(f"array<{LINE}>").alias("line_items"), F.col("x").alias("rich_line_items")).alias("extracted"), F.array().cast("array<string>").alias("pages"))
    out = L.extract_line_items(docs)
    kinds = F.array_join(F.transform("items", lambda i: i["row_type"]), ",")
    return out.select("invoice_id", F.size("items").alias("n"), kinds.alias("kinds"), F.size(F.filter("items", lambda i: i["math_valid"])).alias("holds"), F.size("math_errors").alias("fails"))


@query("q_latest_templates", with_views("SELECT workspace_id, vendor_id, max(id) AS version FROM inv WHERE vendor_id IS NOT NULL GROUP BY 1, 2"))
def q_latest_templates(spark, sf):
    t = D.invoices(spark, sf).filter("vendor_id is not null").select("workspace_id", "vendor_id", F.col("id").alias("version"))
    return N.latest_templates(t).select("workspace_id", "vendor_id", "version")


@query("q_page_kinds", "SELECT doc_id, CASE WHEN length(text) >= 50 * (1 + doc_id % 4) THEN 'text_pdf' ELSE 'scanned_pdf' END AS kind FROM documents")
def q_page_kinds(spark, sf):
    """A document's text is its first page; up to three empty pages follow."""
    page = lambda t: F.struct(F.lit(0).alias("page_num"), t.cast("string").alias("text"))
    empty = F.array_repeat(page(F.lit(None)), (F.col("doc_id") % 4).cast("int"))
    pages = F.concat(F.array(page(F.col("text"))), empty)
    return table(spark, sf, "documents").select("doc_id", classify_pages(pages).alias("kind"))


@query("q_unseen", with_views("SELECT id FROM docs WHERE NOT (status = 'complete' AND file_size_bytes % 2 = 0)"))
def q_unseen(spark, sf):
    d = D.documents(spark, sf)
    known = d.withColumn("errors", F.when(F.col("file_size_bytes") % 2 == 1, F.array(F.lit("failed once"))))
    return unseen(d.select("id"), known).select("id")


_NAMES = {
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "en": "January February March April May June July August September October November December",
}


@query("q_free_dates", "SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 8 = 5 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END AS DATE) AS day FROM orders")
def q_free_dates(spark, sf):
    """The orders' days, written in eight ways and read again."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    d, k = F.col("d"), F.col("id") % 8
    month = lambda lang: F.element_at(F.array(*[F.lit(n) for n in _NAMES[lang].split()]), F.month(d))
    n, y = F.dayofmonth(d).cast("string"), F.year(d).cast("string")
    ending = F.when(n.isin("1", "21", "31"), "st").when(n.isin("2", "22"), "nd").when(n.isin("3", "23"), "rd").otherwise("th")
    today = F.lit("2010-01-01").cast("date")
    said = (
        F.when(k == 0, F.concat(n, F.lit(". "), month("de"), F.lit(" "), y))
        .when(k == 1, F.concat(F.lit("le "), n, F.when(n == "1", "er").otherwise(""), F.lit(" "), month("fr"), F.lit(" "), y))
        .when(k == 2, F.concat(n, F.lit(" de "), month("es"), F.lit(" de "), y))
        .when(k == 3, F.concat(F.date_format(d, "EEEE"), F.lit(", "), month("en"), F.lit(" "), n, ending, F.lit(", "), y, F.lit(" 10:30 pm")))
        .when(k == 4, F.date_format(d, "yyyyMMdd"))
        .when(k == 5, F.concat(month("en"), F.lit(" "), y))
        .when(k == 6, F.date_format(d, "d/M/yy"))
        .otherwise(F.concat(F.datediff(today, d).cast("string"), F.lit(" days ago")))
    )
    return o.select("id", free_date(said, today, day_first=k == 6).alias("day"))


_RECORDED = f"ev AS (SELECT workspace_id, vendor_id, id AS ord, v_number AS number, CASE WHEN id % 2 = 0 THEN '12-3456789' END AS tax_id, CASE currency WHEN '$' THEN 'USD' ELSE currency END AS currency, payment_terms AS terms, (0.0::DOUBLE + {' + '.join(confidence(k, v) for k, (f, v) in FIELD_VALUES if f in ('invoice_number', 'vendor_name', 'total_amount', 'currency'))}) / 4 AS confidence, row_number() OVER (PARTITION BY workspace_id, vendor_id ORDER BY id) AS n, purchase_order IS NOT NULL AS has_order FROM rec WHERE vendor_id IS NOT NULL)"


@query("q_vendor_memory_records", f"WITH RECURSIVE {VIEWS}, {_RECORDED}, {_FOLD}, a AS (SELECT workspace_id, vendor_id, CAST(count(*) AS INTEGER) AS invoice_count, arg_min(currency, ord) AS preferred_currency, arg_min(terms, ord) FILTER (WHERE terms IS NOT NULL) AS preferred_terms, max(tax_id) AS tax_id, CAST(count(DISTINCT number) AS INTEGER) AS n_numbers FROM ev GROUP BY 1, 2) SELECT a.*, CAST(ema AS DECIMAL(9,3)) AS ema, CAST(rate AS DECIMAL(9,3)) AS rate FROM a JOIN (SELECT workspace_id, vendor_id, arg_max(ema, n) AS ema, arg_max(rate, n) AS rate FROM f GROUP BY 1, 2) USING (workspace_id, vendor_id)")
def q_vendor_memory_records(spark, sf):
    """Memory from the records themselves, by chunks."""
    r = D.records(spark, sf).withColumnRenamed("id", "ord")
    events = N.memory_events(r.withColumn("canonicalized", F.struct(normalize_currency(F.col("extracted.currency.value")).alias("currency"))))
    m = F.col("memory")
    out = N.vendor_memory_chained(events, 500)
    return out.select("workspace_id", "vendor_id", m["invoice_count"].alias("invoice_count"), m["preferred_currency"].alias("preferred_currency"), m["preferred_payment_terms"].alias("preferred_terms"), m["tax_id"].alias("tax_id"), F.size(m["historical_invoice_numbers"]).alias("n_numbers"), m["avg_confidence"].cast("decimal(9,3)").alias("ema"), m["rate_purchase_order"].cast("decimal(9,3)").alias("rate"))
