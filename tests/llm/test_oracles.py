"""The corpus queries against their SQL."""

import glob
import os

import duckdb
import pytest

from sedge.llm import oracles, queries

SF = os.environ.get("SEDGE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_oracle(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    result = con.execute(oracles.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted(str(tuple(dict(zip(names, x, strict=True))[c] for c in columns)) for x in result.fetchall())
    assert got == want
