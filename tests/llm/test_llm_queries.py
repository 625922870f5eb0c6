"""Queries against their SQL on the small tables, by DuckDB."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from tessera.llm.queries import QUERIES, SQL  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, DATA)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert key(got.select(*columns).collect()) == key(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
