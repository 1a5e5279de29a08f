"""Every facade query against its DuckDB twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

from veldspar.operators import queries

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{ROOT}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    return round(float(v), 4) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) if hasattr(v, "year") else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, ROOT)
    want = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
