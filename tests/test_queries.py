"""Every registered query against its SQL oracle on the driver tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{value:.6f}" if isinstance(value, (int, float)) else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, sql, name):
    df = driver.queries()[name](spark, DATA)
    rows = df.collect()
    assert rows
    statement = driver.oracle_sql().get(name)
    if statement:
        result = sql.execute(statement)
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert _rows(df.columns, rows) == _rows(columns, result.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
