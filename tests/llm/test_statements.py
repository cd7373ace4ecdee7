"""The corpus queries that have a statement give its rows (small tables)."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from colloquy.llm import queries as Q
from colloquy.sources.shared import scratch

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_statement(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(Q.oracle_sql()[name]).df()
    with scratch(spark):
        got = Q.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cell = lambda v: "null" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    rows = lambda df: sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
