"""Every query with oracle SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from wickwork.jobs import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("region", "nation", "orders", "events", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(db.sql(queries.ORACLES[name]).columns) == cols
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    want = sorted(tuple(map(plain, r)) for r in db.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall())
    assert got == want
