"""Every catalogue query with SQL gives what the SQL gives."""

import math

import duckdb
import pytest

from stridelake.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("customer", "documents", "embeddings", "events", "labels", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str):
        return v
    return round(float(v), 6) + 0.0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in got.collect())
    order = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())
