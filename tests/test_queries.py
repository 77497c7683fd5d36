"""Every registered query with SQL must give the same rows on another engine."""

import math
import os
import re

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

FOLDER = os.environ.get("TERMLOOM_TEST_FOLDER", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SQL = {k: v for k, v in entry.oracle_sql().items() if not re.match(r"op\d|pipeline", k)}


@pytest.fixture(scope="module")
def other():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        table, kind = os.path.splitext(name)
        if kind == ".parquet":
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def lines(columns, rows):
    def text(value):
        if value is None or isinstance(value, float) and math.isnan(value):
            return "NULL"
        return repr(value) if isinstance(value, float) else str(value)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("\x01".join(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, other, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = other.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert lines(df.columns, df.collect()) == lines(columns, cursor.fetchall())


def test_only_runs_with_an_svd_have_no_sql():
    own = {k for k in entry.queries() if not re.match(r"op\d|pipeline", k)}
    assert own - set(SQL) == {"r02_keyword_clusters", "r03_page_title_rows"}


def test_entry(spark):
    assert "opportunity_score" in entry.entry(spark).columns
