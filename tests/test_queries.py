"""Every registered core query with SQL gives the same rows as DuckDB."""

import math
import os

import duckdb
import pytest

from quadrat.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return f"{v:.8g}"
    if isinstance(v, bool):
        return v
    if hasattr(v, "tzinfo"):
        return str(v)
    return f"{float(v):.8g}" if isinstance(v, int) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_and_repeats(spark, name):
    a, b = QUERIES[name](spark, DATA), QUERIES[name](spark, DATA)
    got = rows(a.columns, a.collect())
    assert got and got == rows(b.columns, b.collect())
