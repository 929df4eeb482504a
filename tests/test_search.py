"""Search by many patterns and by vectors, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("sent", [True, False])
def test_templates_by_automata(spark, sent):
    from leafmill.functions.patterns import IndexParams
    from leafmill.operators.vendors import match_templates

    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["É", "ACME", "a.c", "%", "x_y"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(120)] + [None, "", "w1" * 5000]
    docs = [(i, rng.choice(["hot", "hot", "few", "none", None]), t) for i, t in enumerate([*texts, *texts[:5]])]
    prints = [(rng.choice(["hot", "few", None]), rng.randrange(500), rng.choice([" ".join(rng.choices(words, k=rng.randint(1, 3))), None, "acme"]), rng.random() < 0.8) for _ in range(400)]
    prints += [("few", 499, "", True), ("hot", 1, "nowhere at all", True)]
    params = IndexParams() if sent else IndexParams(broadcast_chars=0, block_chars=300, texts_each=10)
    d = spark.createDataFrame([(*r, "clash") for r in docs], "id int, workspace_id string, raw_text string, found string").repartition(3)
    t = spark.createDataFrame(prints, "workspace_id string, template_id int, fingerprint string, is_active boolean")
    got = sorted((r["id"], r["template_id"]) for r in match_templates(d, t, params).collect())
    fits = lambda w, text: [i for g, i, f, on in prints if on and g is not None and g == w and f is not None and text is not None and f.lower() in text.lower()]
    assert got == sorted((i, min(fits(w, text), default=None)) for i, w, text in docs)
    one = match_templates(d, t, params).filter("template_id is not null").first()
    assert (one["workspace_id"], one["template_id"], one["fingerprint"]) in {p[:3] for p in prints}
    assert match_templates(d, t.limit(0), params).filter("template_id is null").count() == len(docs)
    assert match_templates(d.limit(0), t, params).count() == 0


def test_vector_index(spark):
    from leafmill.functions.similarity import vector_top1
    from leafmill.functions.vectors import IndexParams, fit_centroids, indexed_top1, indexed_vectors

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    rows = [("hot" if i % 3 else "few", i, (centres[i % 60] + rng.normal(scale=0.4, size=16)).tolist()) for i in range(3000)]
    rows += [("hot", 9000, [0.0] * 16), ("hot", 9001, None), ("hot", 9002, rows[1][2]), ("hot", 9003, rows[1][2])]
    v = spark.createDataFrame(rows, "workspace_id string, vendor_id long, embedding array<double>")
    q = v.filter("vendor_id % 10 = 1").select("workspace_id", F.col("vendor_id").alias("query_id"), "embedding")
    centroids = fit_centroids(v, IndexParams(cells=32))
    assert len(centroids) == 32
    index = indexed_vectors(v, centroids)
    take = lambda df: {(r["workspace_id"], r["query_id"]): (r["vendor_id"], round(r["score"], 9)) for r in df.collect()}
    exact = take(vector_top1(q, v, 0.5, but_itself=True))
    assert take(indexed_top1(q, index, centroids, 0.5, None, but_itself=True)) == exact
    found = take(indexed_top1(q, index, centroids, 0.5, 8, but_itself=True))
    assert sum(found.get(k) == x for k, x in exact.items()) >= 0.95 * len(exact) and len(exact) > 250
    assert fit_centroids(v.limit(0)).size == 0


def test_embedding_knows_spelling(spark):
    from leafmill.functions.similarity import cosine
    from leafmill.functions.vectors import with_embedding

    pairs = [("Acme Trading Ltd", "ACME trading ltd "), ("Acme Trading Ltd", "Ltd Acme Trading Ltd Acme Trading"), ("Acme Trading Ltd", "Borealis GmbH"), ("", "x"), (None, "x")]
    df = with_embedding(with_embedding(spark.createDataFrame(pairs, "a string, b string"), F.col("a"), "p"), F.col("b"), "q")
    s = [r[0] for r in df.select(cosine(F.col("p"), F.col("q"))).collect()]
    assert abs(s[0] - 1) < 1e-9 and s[1] > 0.8 and s[2] < 0.4 and s[3] is None and s[4] is None


def test_resolution_has_three_stages(spark):
    from leafmill.functions.vectors import fit_centroids, indexed_top1, indexed_vectors
    from leafmill.operators.vendors import resolve_vendors, vendor_vectors

    vendors = spark.createDataFrame([("w", i, n, []) for i, n in enumerate(["Acme Trading Ltd", "Borealis Papier GmbH", "Cedar & Sons"])], "workspace_id string, vendor_id int, canonical_name string, aliases array<string>")
    names = ["Acme Tradin Ltd", "Borealis Papier GmbH Borealis Papier GmbH", "Quite Another Name", "Quite Another Names", " ", None]
    rec = spark.createDataFrame([("w", n, i) for i, n in enumerate(names)], "workspace_id string, name string, arrival int")
    vectors = vendor_vectors(vendors)
    centroids = fit_centroids(vectors)
    searches = [None, lambda asked: indexed_top1(asked, indexed_vectors(vectors, centroids), centroids, probes=None)]
    for search in searches:
        got = {r["name"]: (r["how"], r["vendor_id"]) for r in resolve_vendors(rec, vendors, search=search).collect()}
        assert got[names[0]] == ("fuzzy", "0") and got[names[1]] == ("vector", "1")
        assert got[names[2]][0] == "new" and got[names[2]] == got[names[3]] and len(got) == 4


def test_memory_passes_over_empty_strings(spark):
    from leafmill.operators.vendors import NO_MEMORY, remember, vendor_memory

    rows = [("w", 1, 1, "", "", "", "", 0.5, True, False), ("w", 1, 2, "A1", None, "EUR", "", 0.7, False, True), ("w", 1, 3, "", "T1", "USD", "Net 30", None, False, False)]
    df = spark.createDataFrame(rows, "workspace_id string, vendor_id int, ord int, number string, tax_id string, currency string, terms string, confidence double, has_lines boolean, has_order boolean")
    m = vendor_memory(df).first()["memory"]
    assert (m["historical_invoice_numbers"], m["tax_ids"], m["tax_id"], m["preferred_currency"], m["preferred_payment_terms"]) == (["A1"], ["T1"], "T1", "EUR", "Net 30")
    memory = NO_MEMORY
    for r in rows:
        memory = remember(memory, r[3:])
    assert tuple(m) == memory


def test_memory_by_chunks_is_the_same(spark):
    from leafmill.operators.vendors import vendor_memory, vendor_memory_chained

    rng = random.Random(11)
    rows = [("w" if rng.random() < 0.9 else None, rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(200), rng.choice(["", None, f"N{i % 40}"]), rng.choice([None, "", "T1", "T2"]), rng.choice(["EUR", "", None]), rng.choice([None, "30"]), rng.choice([None, rng.random()]), rng.random() < 0.5, rng.choice([True, False, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "workspace_id string, vendor_id int, ord int, number string, tax_id string, currency string, terms string, confidence double, has_lines boolean, has_order boolean").repartition(3)
    want = sorted(map(repr, vendor_memory(df).collect()))
    assert sorted(map(repr, vendor_memory_chained(df, 17).select("workspace_id", "vendor_id", "memory").collect())) == want
    assert vendor_memory_chained(df.limit(0)).count() == 0
