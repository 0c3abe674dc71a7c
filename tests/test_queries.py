"""Every registered core query against its SQL: the same columns and the same rows."""

import math
from decimal import Decimal

import pytest

from lorefield.plans import queries

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(sf):
    import os

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


def plain(v):
    if isinstance(v, float | Decimal):
        return None if math.isnan(v) else round(float(v), 5)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_names_agree():
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_against_sql(spark, sf, db, name):
    df = queries.queries()[name](spark, sf)
    sql = queries.oracle_sql().get(name)
    if not sql:
        assert df.count() >= 0
        return
    cur = db.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered(df.select(columns).collect()) == ordered(cur.fetchall())


def test_flagship(spark, sf):
    assert queries.flagship(spark, sf).count() > 0
