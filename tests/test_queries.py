"""Every query with SQL against DuckDB; every other one for rows and a stable schema."""

import math

import duckdb
import pytest

from quillon.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.sql(ORACLE[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in places)) for r in found.fetchall())
    got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and all(any(v is not None for v in r) for r in rows)
    numbers = [v for r in rows for v in r if isinstance(v, float)]
    assert not any(math.isnan(v) or math.isinf(v) for v in numbers)
