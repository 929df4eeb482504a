"""Faults that show on larger tables or odd inputs, on rows small enough for a test."""

from pyspark.sql import functions as F


def test_references_without_semicolon_stay(spark):
    from leafmill.functions.text import strip_tags

    texts = ["<title>fine &amp</title>", "&amp;lt; &#39;&nbsp;&copy", "&nosuch; &ampx;", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["t"] for r in df.select("i", strip_tags(F.col("t"), closed_only=True).alias("t")).orderBy("i").collect()]
    assert got == [" fine &amp ", "&lt; '\xa0&copy", "&nosuch; &ampx;", None]


def test_amounts_are_read_once(spark):
    """An expression copied to each of its uses grows beyond what can be compiled; the rules then took hours on large tables."""
    from leafmill.operators import rules as V
    from leafmill.operators.explanation import explain
    from leafmill.sources import domain as D

    sf, key = "/root/testdata/sf0.001", "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(key)
    spark.conf.set(key, "100000")
    try:
        r = D.records(spark, sf).withColumns({"duplicate_of": F.lit(None).cast("string"), "original": F.col("extracted")})
        for df in (V.validate(r), explain(r)):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("[^0-9.,-]") == 3
            assert plan.count("format_number(") <= 15
    finally:
        spark.conf.set(key, before)
    names = [x["rule_name"] for x in V.validate(r).select(F.explode("validation_report.results").alias("x")).limit(14).select("x.rule_name").collect()]
    assert names == list(V.RULES)


def test_nearest_vectors_equal_a_join(spark):
    """Copies tie, ids are ordered as numbers, sizes differ, some vectors have no length; the join of all pairs took hours."""
    import random

    from leafmill.functions.similarity import cosine, vector_top1

    rng = random.Random(3)
    some = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(40)] + [[0.0] * 6, [1.0, 2.0], None]
    rows = [(f"w{i % 2}", 2**53 + 3 * i + 1, some[rng.randrange(len(some))]) for i in range(400)]
    v = spark.createDataFrame(rows, "workspace_id string, vendor_id long, embedding array<float>")
    q = v.filter("vendor_id % 4 = 0").select("workspace_id", F.col("vendor_id").alias("query_id"), "embedding")
    for itself in (False, True):
        pairs = q.withColumnRenamed("embedding", "q").join(v, "workspace_id").withColumn("score", cosine(F.col("q"), F.col("embedding"))).filter("score is not null")
        pairs = pairs.filter("query_id <> vendor_id") if itself else pairs
        best = pairs.groupBy("workspace_id", "query_id").agg(F.min(F.struct((-F.col("score")).alias("o"), "vendor_id", "score")).alias("b"))
        want = {tuple(r) for r in best.select("workspace_id", "query_id", "b.vendor_id", "b.score").filter("score >= 0.2").collect()}
        got = {tuple(r) for r in vector_top1(q, v, 0.2, blocks=3, but_itself=itself, queries_each=20).collect()}
        assert got == want and len(want) > 50
    plan = vector_top1(q, v)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "Join" not in plan


def test_names_of_unfit_lengths_do_not_meet(spark):
    """Short codes and long names share pairs of digits only; before, all that shared one were shuffled as pairs."""
    from leafmill.functions.similarity import fuzzy_matches, similar_names, token_sort_score

    names = [f"Other {i}" for i in range(100, 160)] + [f"Supplier#{i:09d}s" for i in range(20)] + [f"Inc Supplier#{i:09d}" for i in range(9)] + ["V 7", " ", "Supplier#00000001"]
    shown = [f"Supplier#{i:09d}" for i in range(25)] + [f"Supplier#{i:09d} Inc" for i in range(25)] + [f"V{i}" for i in range(100, 160)]
    n = spark.createDataFrame([("w", x) for x in names], "workspace_id string, name string")
    c = spark.createDataFrame([("w", i, x, i) for i, x in enumerate(shown)], "workspace_id string, vendor_id int, display string, position int")
    got = {r["name"]: (r["vendor_id"], r["score"]) for r in fuzzy_matches(n, c).collect()}
    want = {}
    for x in names:
        score, i = min((-token_sort_score(x, y), i) for i, y in enumerate(shown))
        if x.strip() and -score >= 90:
            want[x] = (i, -score)
    assert got == want and len(want) > 25
    pairs = similar_names(n, c.select("workspace_id", F.col("display").alias("other")))
    assert {(r["name"], r["other"]) for r in pairs.collect()} == {(x, y) for x in names for y in shown if token_sort_score(x, y) >= 90}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert any("gram#" in line and "band#" in line for line in plan.splitlines() if "Join Inner" in line)


def test_answers_are_parsed_once(spark):
    from leafmill.operators.extraction import parse_answers
    from leafmill.operators.schemas import FIELDS

    df = spark.createDataFrame([('{"currency": {"value": "EUR", "confidence": 0.5}, "invoice_number": "7", "due_date": null}',), ('{"currency": {"value": "EUR"}, "due',), ("no",), (None,)], "answer string")
    key = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(key)
    spark.conf.set(key, "100000")
    try:
        out = parse_answers(df, F.col("answer"))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("get_json_object(") == plan.count("from_json(") == len(FIELDS)
    got = [None if r["e"] is None else (r["e"]["currency"]["value"], r["e"]["currency"]["confidence"], r["e"]["invoice_number"]["value"], r["e"]["due_date"]["confidence"]) for r in out.select(F.col("extracted").alias("e")).collect()]
    assert got == [("EUR", 0.5, "7", 0.0), ("EUR", 0.0, None, 0.0), None, None]


def test_many_files_are_written_by_many_tasks(spark, tmp_path):
    """One task wrote a folder for each file: 34 ms a file, and a task of the scan for each."""
    import os

    from leafmill.sources.files import put_files, scan

    rows = [(f"{i}.txt", f"höhe {i}\n".encode()) for i in range(90)]
    folder = str(tmp_path / "in")
    put_files(spark.createDataFrame(rows, "name string, content binary").coalesce(1), folder, each=10)
    lie = [(d, f) for d, _, files in os.walk(folder) for f in files]
    assert sorted(f for _, f in lie) == sorted(n for n, _ in rows) and 4 < len({d for d, _ in lie}) <= 9
    got = {r["filename"]: bytes(r["content"]) for r in scan(spark, folder, "ws", "*.txt").collect()}
    assert got == dict(rows)


def test_dealt_texts_and_blocks_have_tasks_of_their_own(spark):
    """All blocks and parts went to a fixed number of tasks, and whole texts were shuffled again as keys: what a task read grew with the square of the input."""
    import re

    from leafmill.functions.patterns import IndexParams, least_pattern

    d = spark.createDataFrame([("w", f"text {i} of {i * 7}") for i in range(300)], "g string, t string")
    p = spark.createDataFrame([("w", f"of {i * 7}", i, None) for i in range(300)], "group string, pattern string, value long, shown string")
    out = least_pattern(d, F.col("g"), F.col("t"), p, "h", IndexParams(broadcast_chars=0, block_chars=500, texts_each=30))
    plan = out._jdf.queryExecution().executedPlan().toString()
    meetings = 10 * -(-sum(len(f"of {i * 7}") + 1 for i in range(300)) // 500)
    assert max(int(n) for n in re.findall(r"hashpartitioning\(group[^,]*, block[^,]*, part[^,]*, (\d+)\)", plan)) == 2 * meetings
    assert not re.search(r"hashpartitioning\([^)]*text#", plan)
    got = {r["t"]: r["h"]["value"] for r in out.collect()}
    assert got == {f"text {i} of {i * 7}": min(k for k in range(300) if f"of {i * 7}".startswith(f"of {k * 7}")) for i in range(300)}


def test_boxes_equal_all_starts_and_windows(spark):
    """The key of the value was made anew for every start and window of a page: a row took time by the square of its words."""
    import random

    from leafmill.operators.confidence import WINDOW, grounding_box

    def plain(value, pages):
        key = lambda t: "".join((t or "").split()).lower()
        for page, words in pages or [] if value and value.strip() else []:
            for i in range(len(words)):
                end = next((j for j in range(i + 1, min(i + WINDOW, len(words)) + 1) if key(value) in "".join(key(t) for t, _ in words[i:j])), None)
                boxes = [b for _, b in words[i:end] if b is not None] if end else []
                if boxes:
                    return page, [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)]
        return None

    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "A b", "ab", "ba", "", " ", None, "É", "x" * 9])
    box = lambda: None if rng.random() < 0.3 else [float(rng.randrange(50)) for _ in range(4)]
    page = lambda: [(word(), box()) for _ in range(rng.choice([0, 1, 2, 5, 20, 60]))]
    value = lambda: rng.choice([None, " ", "".join(w or "" for w in (word() for _ in range(rng.choice([1, 2, 3, 6, 20])))), "ab" * 3, "bxxxxxxxxxa"])
    rows = [(i, value(), None if rng.random() < 0.02 else [(k, page()) for k in range(rng.randint(0, 3))]) for i in range(600)]
    data = [(i, v, ps and [(k, [(t, b, k, 1.0) for t, b in ws]) for k, ws in ps]) for i, v, ps in rows]
    df = spark.createDataFrame(data, "i int, v string, pages array<struct<page_num:int,words:array<struct<text:string,bbox:array<double>,page:int,confidence:double>>>>")
    got = {r["i"]: r["b"] and (r["b"]["page"], r["b"]["bbox"]) for r in df.select("i", grounding_box(F.col("v"), F.col("pages")).alias("b")).collect()}
    assert got == {i: plain(v, ps) for i, v, ps in rows} and sum(x is not None for x in got.values()) > 60
    # Once for the blank value, once for its key and once for the words' keys.
    plan = df.select(grounding_box(F.col("v"), F.col("pages")).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 3


def test_matched_templates_need_no_join(spark):
    """Every row met its template's fingerprint by a join on the template: rows of one template, or of none, went to one task."""
    from leafmill.operators.vendors import match_templates

    t = spark.createDataFrame([("w", 1, "Apache", True), ("w", 2, "MIT", True), ("w", 1, "apache", True)], "workspace_id string, template_id int, fingerprint string, is_active boolean")
    d = spark.createDataFrame([("w", "the apache license"), ("w", "mit"), ("w", "none"), (None, "mit")], "workspace_id string, raw_text string")
    out = match_templates(d, t)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r["template_id"], r["fingerprint"]) for r in out.collect()] == [(1, "Apache"), (2, "MIT"), (None, None), (None, None)]


def test_texts_for_patterns_come_in_bounded_batches(spark):
    """Batches were bounded by their rows only, so a worker's memory grew with the texts."""
    from leafmill.operators.vendors import match_templates

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(1 << 30))
        t = spark.createDataFrame([("w", 1, "x", True)], "workspace_id string, template_id int, fingerprint string, is_active boolean")
        match_templates(spark.createDataFrame([("w", "x")], "workspace_id string, raw_text string"), t)
        assert int(spark.conf.get(key)) <= 2 << 20
    finally:
        spark.conf.set(key, before)


def test_lines_of_an_invoice_meet_once(spark):
    """A window numbered the lines and whole rich items travelled; each line went through a regular expression for each kind."""
    from leafmill.functions.text import ROW_PATTERNS, classify_row_type
    from leafmill.plans.records import items

    plan = items(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("collect_list(") == 1
    said = ["", None, "Widget", "grand\ttotal", "Sub total", "TVA 20%", "taſe", "Envío", "ENVÍO", "less", "lesson", "page 7", "page x", "total\x0bdue", "total\x1cdue", "total\xa0due", "montant ht", "a_tax", "tax-free", "port", "airport", "net\x85amount", "Kless", "discount́"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    slow = F.when(F.coalesce("t", F.lit("")) == "", "unknown")
    for kind, pattern in ROW_PATTERNS:
        slow = slow.when(F.col("t").rlike(rf"(?iU)\b({pattern})\b"), kind)
    got = df.select(classify_row_type(F.col("t")).alias("a"), slow.otherwise("item").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and len({r["a"] for r in got}) == 8
    plan = df.select(classify_row_type(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("octet_length(") < plan.index("(?iU)")
