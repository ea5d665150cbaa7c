"""Every registered query against its SQL twin in DuckDB, over whole small tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import rows_of
from featmart.plans import catalog
from featmart.sources.tables import TABLES

NAMES = sorted(catalog.PLANS)


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return db


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, sf, name):
    df = entry_point.queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name in entry_point.oracle_sql():
        # A twin must be able to stand as a view.
        duck.execute(f"CREATE OR REPLACE VIEW twin AS {entry_point.oracle_sql()[name]}")
        rel = duck.sql("SELECT * FROM twin")
        assert sorted(df.columns) == sorted(rel.columns)
        assert got == rows_of(rel.columns, rel.fetchall())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
