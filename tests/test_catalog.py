"""Every registered query against its SQL on the smallest sample."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as driver
from pagemill import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_of_the_library_has_sql():
    assert set(catalog.queries()) == set(catalog.expected_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = driver.queries()[name](spark, FOLDER)
    expected = duck.sql(driver.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(expected.columns, expected.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
