"""Every registered query of the subpackage that SQL can express equals its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from bazaarium.llm import queries


@pytest.fixture
def tables(small_folder):
    connection = duckdb.connect()
    for path in Path(small_folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, small_folder, tables, name):
    found = queries.queries()[name](spark, small_folder)
    columns = sorted(found.columns)
    expected = tables.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    got = [tuple(row) for row in found.select(*columns).collect()]
    assert got and sorted(got, key=repr) == sorted(expected, key=repr)
