"""Every query of the catalog against its SQL on the smallest data folder."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, comparable
from marketlens.catalog import QUERIES
from marketlens.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    got = comparable(QUERIES[name](spark, FOLDER).toPandas())
    want = comparable(db.execute(ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want)
