"""Every registered query against its SQL on the smallest tables, and the driver's contract."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from notelens.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(int(value)) if isinstance(value, bool) or hasattr(value, "is_integer") and value == int(value) else str(value)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    wanted = db.sql(catalogue.oracle_sql()[name])
    at = [wanted.columns.index(c) for c in columns]
    assert sorted(wanted.columns) == columns
    assert found == sorted(tuple(plain(r[i]) for i in at) for r in wanted.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "score", "passage_no"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
