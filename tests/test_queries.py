"""Every query against its SQL by DuckDB; queries without SQL run and give rows."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from tessera.oracles import SQL  # noqa: E402
from tessera.queries import QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA)
    if name not in SQL:
        assert got.count() > 0
        return
    want = con.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert key(got.select(*columns).collect()) == key(con.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall())
