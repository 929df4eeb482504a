"""Rules, confidence, grounding, memory, ingestion, extraction and streams on small rows."""

import os
import random

import pytest

from pyspark.sql import functions as F

from leafmill.operators import confidence as C
from leafmill.operators import rules as V
from leafmill.operators import vendors as N
from leafmill.operators.explanation import explain
from leafmill.operators.extraction import extract, fallback, read_labels
from leafmill.operators.lineitems import math_holds
from leafmill.operators.schemas import EXTRACTED, FIELDS, PAGE

E2E = {"invoice_number": ("INV-2024-001", 0.95), "invoice_date": ("2024-01-15", 0.9), "due_date": ("2024-02-15", 0.88), "vendor_name": ("Acme Corp", 0.92), "buyer_name": ("Beta Inc", 0.85), "subtotal": ("1000.00", 0.93), "tax_amount": ("100.00", 0.91), "total_amount": ("1100.00", 0.96), "currency": ("USD", 0.99), "payment_terms": ("Net 30", 0.87)}


def record(spark, values=E2E, text=None, pages=None, matched=False, **extra):
    field = lambda f: (values.get(f, (None, 0.0))[0], values.get(f, (None, 0.0))[1], None, None, None)
    text = " ".join(v for v, _ in values.values() if v) + " " * 200 if text is None else text
    row = (1, tuple(field(f) for f in FIELDS) + ([], []), text, pages, matched)
    df = spark.createDataFrame([row], f"id int, extracted {EXTRACTED}, raw_text string, pages array<{PAGE}>, vendor_matched boolean")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def statuses(df):
    return {r["rule_name"]: r["status"] for r in df.first()["validation_report"]["results"]}


def test_all_rules_pass_on_a_sound_invoice(spark):
    df = V.validate(record(spark).withColumn("duplicate_of", F.lit(None).cast("string")))
    s = statuses(df)
    assert list(s) == list(V.RULES) and len(s) == 14 and set(s.values()) == {"pass"}
    assert df.first()["validation_report"]["is_valid"]


def test_rules_fail_warn_and_skip(spark):
    bad = {"vendor_name": ("12-34", 0.9), "invoice_date": ("soon", 0.9), "currency": ("$", 0.9), "subtotal": ("100", 0.9), "tax_amount": ("-300", 0.9), "total_amount": ("-1", 0.9), "payment_terms": ("cash", 0.9)}
    s = statuses(V.validate(record(spark, bad).withColumn("duplicate_of", F.lit("d2"))))
    assert s == {"invoice_number_exists": "fail", "vendor_exists": "pass", "vendor_name_valid": "fail", "invoice_date_valid": "fail", "due_date_after_invoice_date": "skip", "currency_iso_4217": "fail", "decimal_validation": "pass", "tax_non_negative": "fail", "total_equals_subtotal_plus_tax": "fail", "duplicate_invoice_detection": "skip", "mandatory_fields": "fail", "payment_terms_valid": "warn", "tax_percentage_validation": "warn", "invalid_amount_detection": "fail"}


def test_confidence_of_the_known_record(spark):
    r = C.score(record(spark)).first()
    scores = {s["name"]: s["score"] for s in r["signals"]}
    assert round(scores["llm"], 4) == 0.6543 and scores["math"] == 1.0 and round(scores["completeness"], 4) == round(10 / 14, 4)
    assert round(r["overall"], 2) == 0.70 and r["low_confidence"]
    assert round(C.score(record(spark, matched=True)).first()["overall"], 6) == 0.75


def test_grounding_caps_and_places(spark):
    words = [("Invoice", [0.0, 0.0, 50.0, 10.0], 0, 1.0), ("INV-2024-001", [55.0, 0.0, 150.0, 10.0], 0, 1.0), ("total", [0.0, 20.0, 40.0, 30.0], 0, 1.0)]
    pages = [(0, "Invoice INV-2024-001 total", words)]
    r = C.ground(record(spark, {"invoice_number": ("INV-2024-001", 0.9), "buyer_name": ("Nobody", 0.9)}, "Invoice INV-2024-001 total", pages)).first()["extracted"]
    assert r["invoice_number"]["bbox"] == [0.0, 0.0, 150.0, 10.0] and r["invoice_number"]["page"] == 0
    assert r["invoice_number"]["confidence"] == 0.9 and r["buyer_name"]["confidence"] == 0.5


def test_explanation(spark):
    df = record(spark, {"currency": ("USD", 0.9), "buyer_name": ("Nobody", 0.9)}, "only USD here").withColumn("original", F.col("extracted"))
    r = explain(df).first()["explanation"]
    f = {x["field_name"]: x for x in r["fields"]}
    assert [s["label"] for s in f["currency"]["signals"]] == ["llm_base", "known_iso4217_currency", "grounded_in_source"]
    lost = f["buyer_name"]["signals"][1]
    assert lost["label"] == "not_grounded_in_source" and round(lost["delta"], 6) == -0.4 and r["grounding_applied"]


def test_line_math(spark):
    rows = [("2", "50", "100", True), ("2", "50", "90", False), ("3", "33.33", "100.00", True), (None, "1", "1", None), ("3", "1.234,00", "3.702,00", True), ("-1", "50", "-50", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, p string, t string, want boolean")
    assert [r[0] for r in df.orderBy("i").select(math_holds(F.col("q"), F.col("p"), F.col("t"))).collect()] == [r[3] for r in rows]


def test_memory_fold(spark):
    rows = [("w", 1, i, f"N{i % 2}", "T1" if i else None, "EUR" if i else None, None, c, True, i == 0) for i, c in enumerate([0.9, 0.8, 0.7])]
    df = spark.createDataFrame(rows, "workspace_id string, vendor_id int, ord int, number string, tax_id string, currency string, terms string, confidence double, has_lines boolean, has_order boolean")
    m = N.vendor_memory(df).first()["memory"]
    assert (m["avg_confidence"], m["historical_invoice_numbers"], m["preferred_currency"], m["invoice_count"], m["rate_line_items"], m["rate_purchase_order"]) == (0.844, ["N0", "N1"], "EUR", 3, 1.0, 0.333)


def test_boost(spark):
    v = spark.createDataFrame([(7, "Acme", "usd", "net  30", ["INV-2024-001"], 0.5, 10)], "vendor_id int, canonical_name string, preferred_currency string, preferred_payment_terms string, historical_invoice_numbers array<string>, avg_confidence double, invoice_count int")
    r = N.boost(record(spark, vendor_id=7), v).first()
    assert [round(r["extracted"][f]["confidence"], 4) for f in ("currency", "payment_terms", "invoice_number")] == [1.0, 0.95, 0.75]
    assert len(r["boost_reasons"]) == 2 and "'INV-2024-001' seen before" in r["boost_reasons"][0]


def test_vendor_resolution(spark):
    v = spark.createDataFrame([("w", "v1", "Acme Corp", ["ACME", "Acme Inc"]), ("w", "v2", "Beta Inc", ["Beta Incorporated"])], "workspace_id string, vendor_id string, canonical_name string, aliases array<string>")
    names = ["Acme Corp", "Acme Inc", "ACME", "Unknown Vendor XYZ", "Unknown Vendor XYZZ", " "]
    rec = spark.createDataFrame([("w", n, i) for i, n in enumerate(names)], "workspace_id string, name string, arrival int")
    got = {r["name"]: (r["vendor_id"], r["how"]) for r in N.resolve_vendors(rec, v).collect()}
    assert [got[n] for n in names[:3]] == [("v1", "fuzzy")] * 3 and got[names[3]][1] == "new" and got[names[3]] == got[names[4]] and " " not in got


def test_ingest_and_extract(spark, tmp_path):
    from leafmill.sources import files as S

    (tmp_path / "a.txt").write_text("Invoice No: INV-9\nTotal: $12.00\nCurrency: USD\n")
    (tmp_path / "b.eml").write_bytes(b"Subject: Bill\r\nContent-Type: text/html\r\n\r\n<p>Total: 5 &amp; more</p>")
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "copy.txt").write_text("Invoice No: INV-9\nTotal: $12.00\nCurrency: USD\n")
    found = S.scan(spark, str(tmp_path), "w")
    assert {r["filename"]: r["status"] for r in found.collect()}["c.exe"] == "rejected"
    docs = S.read_pages(S.first_arrivals(found.filter("status = 'processing'")))
    rows = {os.path.splitext(r["filename"])[1]: r for r in docs.collect()}
    assert len(rows) == 3 and "Subject: Bill" in rows[".eml"]["raw_text"] and "5 & more" in rows[".eml"]["raw_text"] and rows[".pdf"]["errors"][0]["fatal"]
    e = {os.path.splitext(r["filename"])[1]: r for r in extract(docs, fallback(lambda t: 1 / 0, read_labels)).collect()}
    assert e[".txt"]["extracted"]["invoice_number"]["value"] == "INV-9" and e[".txt"]["extracted"]["total_amount"]["value"] == "$12.00" and e[".pdf"]["extract_error"] == "empty text"


def test_streamed_memory_equals_the_fold(spark, tmp_path):
    from leafmill.streaming import streams

    rows = [("w", k, i, f"N{i % 3}" if i % 5 else None, f"T{i % 2}" if i % 4 else None, "USD" if i > 2 else None, "Net 30", (i % 10) / 10 + 0.05, i % 3 == 0, i % 7 == 0) for i in range(30) for k in (1, 2)]
    schema = "workspace_id string, vendor_id long, ord int, number string, tax_id string, currency string, terms string, confidence double, has_lines boolean, has_order boolean"
    df = spark.createDataFrame(rows, schema)
    for k in range(3):  # files in the order of the invoices, one for each micro-batch
        df.filter(f"ord between {10 * k} and {10 * k + 9}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.memory_stream(streams.event_stream(spark, str(tmp_path / "in"), df.schema, 1))
    got = {r["vendor_id"]: tuple(r[c] for c in N.MEMORY_NAMES) for r in streams.run_once(stream, ["workspace_id", "vendor_id"]).collect()}
    want = {r["vendor_id"]: tuple(r["memory"]) for r in N.vendor_memory(df).collect()}
    assert got == want and want[1][0] == 30 and want[1][2] == ["N1", "N2", "N0"] and want[1][5] == "USD"


def test_memory_of_many_vendors(spark):
    rng = random.Random(3)
    rows = [("w", rng.randint(1, 40), i, f"N{rng.randint(0, 9)}", None, rng.choice([None, "EUR", "USD"]), None, rng.random(), rng.random() < 0.5, None) for i in range(800)]
    schema = "workspace_id string, vendor_id int, ord int, number string, tax_id string, currency string, terms string, confidence double, has_lines boolean, has_order boolean"
    want = {}
    for w, v, _, *event in rows:
        want[v] = N.remember(want.get(v, N.NO_MEMORY), event)
    got = {r["vendor_id"]: tuple(r["memory"]) for r in N.vendor_memory(spark.createDataFrame(rows, schema).repartition(5)).collect()}
    assert got == want
    assert N.vendor_memory(spark.createDataFrame(rows, schema).limit(0)).count() == 0


def test_similar_names_lose_nothing(spark):
    from leafmill.functions.similarity import similar_names, token_sort_score

    rng = random.Random(8)
    base = ["ACME Trading Ltd", "24 ACME Trading Ltd", "Acme", " Acme", "aaaaaaaa", "aaaaaaaaa", "a", "b", "", "  ", "Müller GmbH", "GmbH Müller", "x\xa0y z"] + ["".join(rng.choices("abcde ", k=rng.randint(1, 14))) for _ in range(120)] + [" ".join(rng.choices(["north", "south", "supply", "trading", "co", "ltd"], k=rng.randint(1, 5))) for _ in range(80)]
    names = sorted(set(base))
    left = spark.createDataFrame([("w", n) for n in names], "workspace_id string, name string")
    got = {(r["name"], r["other"]): r["score"] for r in similar_names(left, left.withColumnRenamed("name", "other")).collect()}
    want = {(a, b): s for a in names for b in names if (s := token_sort_score(a, b)) >= 90}
    assert got == want


def test_new_names_lead_in_arrival_order(spark):
    from leafmill.functions.similarity import token_sort_score

    rng = random.Random(9)
    words = ["ACME", "Trading", "Ltd", "24", "North", "Supply", "Inc"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(2, 6))) + rng.choice(["", "", "s", "."]) for _ in range(150)})
    rng.shuffle(names)
    rows = [("w", n, i // 2) for i, n in enumerate(names)]
    leaders, want = [], {}
    for _, n, i in sorted(rows, key=lambda r: (r[2], r[1])):
        want[n] = next((x for x in leaders if token_sort_score(x, n) >= 90), n)
        leaders += [n] if want[n] == n else []
    got = {}
    for r in N.lead_new_names(spark.createDataFrame(rows, "workspace_id string, name string, arrival int")).collect():
        got.setdefault(r["vendor_id"], set()).add(r["name"])
    groups = {}
    for n, x in want.items():
        groups.setdefault(x, set()).add(n)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values())) and len(leaders) < len(names)


def test_products_fold_against_counting(spark):
    from collections import Counter

    rng = random.Random(4)
    lists = [[f"product {'long ' * 10}{rng.randint(0, 40)}" for _ in range(rng.randint(0, 15))] for _ in range(20)]
    kept: list = []
    for new in lists:
        kept = [p for p, _ in Counter([*kept, *new]).most_common(20)]
    got = spark.createDataFrame([(lists,)], "p array<array<string>>").select(N.products_fold(F.col("p")).alias("k")).first()["k"]
    assert got == kept
    rows = [(v, i, p) for v in (1, 2) for i, new in enumerate(lists) for p in new]
    rng.shuffle(rows)
    kept = []
    for new in lists:
        kept = [p for p, _ in Counter([*kept, *sorted(new)]).most_common(20)]
    got = {r["vendor_id"]: r["products"] for r in N.products_by_order(spark.createDataFrame(rows, "vendor_id int, ord int, product string").repartition(4)).collect()}
    assert got == {1: kept, 2: kept}


def test_character_references(spark):
    import html

    from leafmill.functions.text import strip_tags

    texts = ["<b>caf&eacute;</b> &#8217;&#xe9; &mdash; &hellip; &amp;lt; &nosuch; &lt;i&gt;", "no ref", None, "&copy &notit; &#0; &#x110000;"]
    got = [r["t"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(strip_tags(F.col("t")).alias("t")).collect()]
    assert got == [None if t is None else html.unescape(__import__("re").sub("<[^>]+>", " ", t)) for t in texts]


def test_metrics(spark):
    from leafmill.operators.reports import precision_recall

    df = spark.createDataFrame(list(zip([True, True, False, False, True], [True, False, True, False, True])), "truth boolean, predicted boolean")
    r = precision_recall(df).first()
    assert round(r["precision"], 6) == round(r["recall"], 6) == round(2 / 3, 6) and r["support"] == 3


def test_bundle_and_purge(spark, tmp_path):
    from leafmill.plans.reading import positioned
    from leafmill.sources import domain as D
    from leafmill.sources.sinks import write_bundle

    sf = "/root/testdata/sf0.001"
    tables = {"invoices": D.invoices(spark, sf).withColumn("validation_report", F.lit(None).cast("string")), "documents": D.documents(spark, sf), "vendors": D.vendors(spark, sf), "line_items": positioned(D.lines(spark, sf))}
    n = tables["invoices"].filter("workspace_id = 'ws1'").count()
    left = write_bundle(tables, str(tmp_path / "bundle"), "ws1")
    assert spark.read.json(str(tmp_path / "bundle/json")).count() == n and left["invoices"].filter("workspace_id = 'ws1'").count() == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "bundle/invoices")).count() == n and len(left["line_items"].columns) == len(tables["line_items"].columns)


def test_readers_in_turn_and_what_is_new(spark):
    from leafmill.sources import files as S

    def engine(score, text):
        return lambda content, mime: [{"text": text, "words": [{"text": text, "confidence": score, "bbox": [0.0, 0.0, 1.0, 1.0], "page": 0}]}]

    def broken(content, mime):
        raise ValueError("no engine")

    read = lambda *e: S.cascade(*e)(b"", "image/png")[0]["text"]
    assert read(engine(0.39, "a"), engine(0.4, "b"), engine(0.9, "c")) == "b" and read(engine(0.1, "a"), engine(0.2, "b")) == "b"
    assert read(broken, engine(0.1, "b")) == "b" and S.cascade()(b"", "") == []
    with pytest.raises(ValueError):
        read(engine(0.1, "a"), broken)
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    done = spark.createDataFrame([("a", "complete", None), ("b", "complete", ["e"]), ("c", "failed", None)], "id string, status string, errors array<string>")
    assert sorted(r["id"] for r in S.unseen(files, done).collect()) == ["b", "c", "d"] and S.unseen(files, done, force=True).count() == 4
    page = lambda n: [{"text": "x" * n}]
    pages = spark.createDataFrame([(page(50),), (page(49),), ([],)], "pages array<struct<text:string>>")
    assert [r["k"] for r in pages.select(S.classify_pages(F.col("pages")).alias("k")).collect()] == ["text_pdf", "scanned_pdf", "scanned_pdf"]


def test_mail_attachments():
    from email.message import EmailMessage

    from leafmill.sources.mail import attachments, open_box

    m = EmailMessage()
    m["Subject"], m["From"], m["Message-ID"] = "Bills", "a@example.com", "<1@x>"
    m.set_content("see attached")
    m.add_attachment(b"%PDF-1", maintype="application", subtype="pdf", filename="bill.pdf")
    m.add_attachment(b"zip", maintype="application", subtype="zip", filename="no.zip")
    m.add_attachment(b"%PDF-2", maintype="application", subtype="pdf")
    found = list(attachments(m.as_bytes()))
    assert [(f[1], f[3][:11], f[4], f[5]) for f in found] == [("Bills", "bill.pdf", "application/pdf", b"%PDF-1"), ("Bills", "attachment_", "application/pdf", b"%PDF-2")]
    with pytest.raises(ValueError):
        open_box({})


def test_answers_and_latest_templates(spark):
    from leafmill.functions.text import fenced_json
    from leafmill.sources.sinks import observed

    said = ['Here:\n```json\n{"a": 1}\n```', '```\n{"b": 2}```', '{"c": 3}']
    assert [r["j"] for r in spark.createDataFrame([(t,) for t in said], "t string").select(fenced_json(F.col("t")).alias("j")).collect()] == ['{"a": 1}', '{"b": 2}', '{"c": 3}']
    t = spark.createDataFrame([("w", 1, 1, "old"), ("w", 1, 3, "new"), ("w", 2, 1, "only")], "workspace_id string, vendor_id int, version int, fingerprint string")
    assert sorted(r["fingerprint"] for r in N.latest_templates(t).collect()) == ["new", "only"]
    df, counters = observed(spark.createDataFrame([("failed",), ("complete",), ("needs_review",), ("failed",)], "status string"), "seen")
    df.collect()
    assert counters.get == {"rows": 4, "failed": 2, "needs_review": 1}


def test_upsert_sink(spark, tmp_path):
    from leafmill.streaming.streams import event_stream, upsert_sink

    spark.createDataFrame([(i,) for i in range(10)], "i int").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):  # the second run finds nothing new
        stream = event_stream(spark, str(tmp_path / "in"), "i int")
        upsert_sink(stream, lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "progress")).awaitTermination()
    assert seen == [(0, 10)]
