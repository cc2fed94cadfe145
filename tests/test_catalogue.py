import datetime
import decimal
import math

import duckdb
import pytest

from colloquy.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 4) + 0.0
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)[:10] if isinstance(x, datetime.datetime) and x.time() == datetime.time() else str(x)
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = sorted((tuple(value(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    assert got
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    rel = duck.execute(sql)
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in sorted(columns)]
    want = sorted((tuple(value(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    assert got == want
