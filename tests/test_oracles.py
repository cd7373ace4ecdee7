"""Every registered query that has a statement gives its rows (small tables)."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from colloquy.plans import consensus, events, redaction, streams, texts

DATA = "/root/testdata/sf0.001"
NAMES = [n for plan in (consensus, events, redaction, streams, texts) for n in plan.QUERIES if n in plan.ORACLES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    def cell(v):
        return "null" if v is None or v != v else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(got) == rows(want)
