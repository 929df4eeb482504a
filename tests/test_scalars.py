"""Golden values of the scalar functions."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.amounts import parse_amount, parse_decimal
from leafmill.functions.similarity import cosine, fuzzy_matches, token_sort_score, vector_top1


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("o")).collect()]


def test_parse_amount(spark):
    cases = {"1234.56": "1234.56", "$1,234.56": "1234.56", None: None, "": None, "1.000,00": "1000", "100,00": "100", "1.100,00": "1100", "75 974,00": "75974", "abc-not-number": None, "1,234": "1234", "1.234": "1234", "1234.567": "1234.567", ".125": "0.125", "0.125": "125", "1.234.567": "1234567", "1,234.567,89": None, "-5": "-5", "--5": None, "-1,234": "-1234"}
    got = column(spark, list(cases), parse_amount)
    assert got == [None if v is None else Decimal(v) for v in cases.values()]


def test_parse_decimal(spark):
    cases = {"100": "100", "12.50": "12.5", "$1,234.56": "1234.56", "1.234,56": "1234.56", "75,50": "75.5", None: None, "": None, "N/A": None, "-50.00": "-50", "75 974,00": "75974", "1,234": "1.234", "1,234,567": None, "-1.234,56": "-1.23456"}
    assert column(spark, list(cases), parse_decimal) == [None if v is None else Decimal(v) for v in cases.values()]


def test_row_types(spark):
    cases = {"Widget A": "item", "Discount 10%": "discount", "Remise spéciale": "discount", "TVA 20%": "tax", "VAT 5%": "tax", "Subtotal": "subtotal", "Total HT": "subtotal", "Grand Total": "total", "Total Due": "total", "Shipping": "shipping", "Frais de port": "shipping", "Continued from page 1": "header", None: "unknown", "": "unknown", "Total": "item"}
    assert column(spark, list(cases), T.classify_row_type) == list(cases.values())


def test_currencies_and_dates(spark):
    assert column(spark, ["$", " eur ", "R$", "dollars", None, "US"], T.normalize_currency) == ["USD", "EUR", "BRL", None, None, None]
    got = column(spark, ["2024-01-15", "January 5, 2024", "15.01.2024", "25/12/2023", "soon", None], lambda c: T.parse_date(c).cast("string"))
    assert got == ["2024-01-15", "2024-01-05", "2024-01-15", "2023-12-25", None, None]


def test_terms_keys_and_quotes(spark):
    assert column(spark, ["Net 30", "special", "cash", "2/10 net 30"], T.is_payment_terms) == [True, True, False, True]
    assert column(spark, ["In V 1", "Straße"], T.ground_key) == ["inv1", "strasse"]
    assert column(spark, ["a", "it's", None], T.quoted) == ["'a'", '"it\'s"', "None"]
    assert column(spark, ["x ```json\n{1}\n``` y", "{2}"], T.fenced_json) == ["{1}", "{2}"]
    assert column(spark, ["12-3456789", "123456789", " DE 123456789 ", "x"], T.validate_tax_id) == ["12-3456789", "12-3456789", "DE123456789", "x"]


@pytest.mark.parametrize("a,b,score", [("Corp Acme", "Acme Corp", 100), ("Acme Corps", "Acme Corp", 94.737), ("Delta Solutions Inc", "Delta Solutions", 88.235), ("acme corp", "Acme Corp", 77.778), ("Acme Inc", "Acme Corp", 58.824)])
def test_token_sort(a, b, score):
    assert round(token_sort_score(a, b), 3) == score


def test_fuzzy_join_finds_what_all_pairs_find(spark):
    names = ["Acme Corp", "Corp Acme", "Acme Corps", "ACME", "Acme Inc", "Unknown Vendor XYZ", "", "Beta  Inc"]
    cands = [("w", 1, "Acme Corp", 1), ("w", 1, "ACME", 2), ("w", 1, "Acme Inc", 3), ("w", 2, "Beta Inc", 4), ("w", 3, "Acme Inc", 5)]
    got = {r["name"]: (r["vendor_id"], round(r["score"], 3)) for r in fuzzy_matches(spark.createDataFrame([("w", n) for n in names], "workspace_id string, name string"), spark.createDataFrame(cands, "workspace_id string, vendor_id int, display string, position int")).collect()}
    last = {d: v for _, v, d, _ in cands}
    want = {}
    for n in names:
        best = max(((token_sort_score(n, d), -p, last[d]) for _, _, d, p in cands if n), default=None)
        if best and best[0] >= 90:
            want[n] = (best[2], round(best[0], 3))
    assert got == want


def test_cosine_and_top1(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [None if r[0] is None else round(r[0], 6) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, None]
    q = spark.createDataFrame([("w", 1, [1.0, 0.1])], "workspace_id string, query_id int, embedding array<double>")
    v = spark.createDataFrame([("w", "a", [1.0, 0.0]), ("w", "b", [0.0, 1.0]), ("x", "c", [1.0, 0.1])], "workspace_id string, vendor_id string, embedding array<double>")
    assert [r["vendor_id"] for r in vector_top1(q, v).collect()] == ["a"]


def test_coerced_fields(spark):
    df = spark.createDataFrame([('{"a": "x", "b": {"value": "y", "confidence": 0.5}, "c": null}',)], "j string")
    r = df.select(*[T.coerce_field(F.col("j"), k).alias(k) for k in "abcd"]).first()
    assert [(r[k]["value"], r[k]["confidence"]) for k in "abcd"] == [("x", 1.0), ("y", 0.5), (None, 0.0), (None, 0.0)]
