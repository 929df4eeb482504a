"""Every query of the engine against its SQL twin, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from leafmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(tuple(map(norm, r)) for r in got.select(*cols).collect())
    if name in registry.oracle_sql():
        want = db.sql(registry.oracle_sql()[name])
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert rows == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())
