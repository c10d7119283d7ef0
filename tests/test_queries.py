"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(values, columns):
    """Rows with their columns in order of names, sorted by what isn't a float first."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [[None if v[i] is None or v[i] != v[i] else v[i] for i in order] for v in values]
    key = lambda r: ([str(x) for x in r if not isinstance(x, float)], [x for x in r if isinstance(x, float)])
    return sorted(plain, key=key)


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-5, abs_tol=2e-6)
    return str(a) == str(b)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    cursor = tables.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got, expected = rows([tuple(r) for r in df.collect()], df.columns), rows(cursor.fetchall(), columns)
    assert len(got) == len(expected)
    assert [(g, e) for g, e in zip(got, expected, strict=True) if not all(map(same, g, e))] == []


def test_every_query_has_a_name_and_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_entry(spark):
    assert entry.entry(spark).count() == 121
