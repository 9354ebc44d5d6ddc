"""Every registered query against its SQL, run by DuckDB on the same tables."""

import math
import os
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 9)
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_plain(row[i]) for i in order) for row in rows], key=repr)


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert registry.library_queries().keys() == registry.library_sql().keys()


@pytest.mark.parametrize("name", list(registry.library_queries()))
def test_query_equals_sql(spark, oracle, name):
    found = registry.library_queries()[name](spark, SF_DIR)
    wanted = oracle.execute(registry.library_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert _rows(found.columns, found.collect()) == _rows(names, wanted.fetchall())


def test_entry(spark):
    assert registry.entry(spark).count() > 0
