"""Each query against DuckDB over the same tables."""

import datetime
import math
from decimal import Decimal

import duckdb
import pytest

from loadlens import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, datetime.date)):
        return str(x)
    if isinstance(x, (float, Decimal)):
        return "nan" if math.isnan(x) else f"{float(x):.6g}"
    return str(x)


@pytest.mark.parametrize("name", [n for n, q in catalog.queries().items() if q.oracle])
def test_same_as_duckdb(spark, duck, name):
    q = catalog.queries()[name]
    df = q(spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(q.oracle)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    spark.catalog.clearCache()


def test_every_query_has_sql():
    assert all(q.oracle for q in catalog.queries().values())
