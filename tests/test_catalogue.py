"""Every registered query of the engine against DuckDB on the smallest tables."""

import glob
import os

import pytest

from mnemolake.catalogue import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.exists(FOLDER):
        pytest.skip("no test data")
    connection = duckdb.connect()
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return connection


def _sorted(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = _sorted(QUERIES[name](spark, FOLDER).toPandas())
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = _sorted(duck.sql(ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for column in got.columns:
        same = (got[column] == want[column]) | (got[column].isna() & want[column].isna())
        assert same.all(), column


def test_oracles_belong_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
