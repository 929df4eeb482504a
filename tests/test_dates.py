"""Dates as people write them."""

import datetime

from pyspark.sql import functions as F

TODAY = datetime.date(2024, 3, 31)


def day(y, m=None, d=1):
    return datetime.date(y, m, d) if m else None


CASES = {
    "2024-01-15": day(2024, 1, 15), "January 15, 2024": day(2024, 1, 15), "": None, "not-a-date-xyz": None, None: None, "soon": None, "2024/1/5": day(2024, 1, 5), "2024-01-15T10:30:00Z": day(2024, 1, 15),
    "2024-01-15 10:30:00.123 +02:00": day(2024, 1, 15), "Jan 5th, 2024 at 3:15 pm": day(2024, 1, 5), "15 Jan 24": day(2024, 1, 15), "15-Jan-1999": day(1999, 1, 15), "1/2/2024": day(2024, 1, 2), "13/2/2024": day(2024, 2, 13),
    "02/13/24": day(2024, 2, 13), "31.12.99": day(1999, 12, 31), "12.31.68": day(2068, 12, 31), "Monday, 5 February 2024": day(2024, 2, 5), "the 3rd of May 2024": day(2024, 5, 3), "May 2024": day(2024, 5), "2024 May": day(2024, 5),
    "5 May": day(2024, 5, 5), "May 5": day(2024, 5, 5), "1er février 2024": day(2024, 2, 1), "le 3 août 2023": day(2023, 8, 3), "3. März 2024": day(2024, 3, 3), "Dienstag, den 3. Dezember 2024": day(2024, 12, 3), "3 de enero de 2024": day(2024, 1, 3),
    "15 gennaio 2024": day(2024, 1, 15), "15 de março de 2024": day(2024, 3, 15), "15 maart 2024": day(2024, 3, 15), "20240229": day(2024, 2, 29), "20230229": None, "30 February 2024": None, "1484823450": day(2017, 1, 19), "today": TODAY,
    "Yesterday": day(2024, 3, 30), "morgen": day(2024, 4, 1), "hier": day(2024, 3, 30), "3 days ago": day(2024, 3, 28), "2 weeks ago": day(2024, 3, 17), "1 month ago": day(2024, 2, 29), "in 2 years": day(2026, 3, 31), "il y a 3 jours": day(2024, 3, 28),
    "vor 2 Wochen": day(2024, 3, 17), "hace 1 mes": day(2024, 2, 29), "dans 10 jours": day(2024, 4, 10), "15 agosto 2024": day(2024, 8, 15), "99/99/2024": None, "12345": None,
}


def test_forms(spark):
    from leafmill.functions.dates import free_date

    df = spark.createDataFrame([(k,) for k in CASES], "said string")
    got = {r[0]: r[1] for r in df.select("said", free_date(F.col("said"), F.lit(TODAY))).collect()}
    assert {k: v for k, v in got.items() if v != CASES[k]} == {}


def test_every_month_of_every_language(spark):
    from leafmill.functions.dates import MONTHS, free_date

    rows = [(f"{d} {name} 2021", m, d) for m, names in enumerate(MONTHS, 1) for d, name in enumerate(names.split(), 3)]
    rows += [(f"{name.upper()} {d}, 2021", m, d) for m, names in enumerate(MONTHS, 1) for d, name in enumerate(names.split(), 3)]
    assert len(rows) > 200
    df = spark.createDataFrame(rows, "said string, m int, d int")
    wrong = df.filter(~free_date(F.col("said")).eqNullSafe(F.make_date(F.lit(2021), "m", "d"))).collect()
    assert wrong == []


def test_order_by_language(spark):
    from leafmill.functions.dates import free_date

    df = spark.createDataFrame([("03/04/2024", "en"), ("03/04/2024", "fr"), ("04.03.24", "de")], "said string, lang string")
    got = [r[0] for r in df.select(free_date(F.col("said"), day_first=F.col("lang") != "en")).collect()]
    assert got == [day(2024, 3, 4), day(2024, 4, 3), day(2024, 3, 4)]
