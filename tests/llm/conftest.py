from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import pytest
from pyspark.sql import DataFrame

from bazaarium.llm.common import ship_package

#: Columns that clash with names the operators might use inside, and with the result's.
CLASHING = "kept string, digest int, n_tokens int, class string, trie_key string, size int, `a.b` int"


@pytest.fixture
def docs(spark) -> Callable[..., DataFrame]:
    """(doc_id, text) rows as a table with further columns; a row may be repeated."""
    ship_package(spark)

    def make(*rows: tuple[int | None, str | None], clashing: bool = True) -> DataFrame:
        if not clashing:
            return spark.createDataFrame(list(rows), "doc_id long, text string")
        more = ("x", 1, 2, "c", "k", 3, 4)
        return spark.createDataFrame([(*row, *more) for row in rows], f"doc_id long, text string, {CLASHING}")

    return make


@pytest.fixture
def small_folder(spark) -> str:
    ship_package(spark)
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("test tables are not present")
    return str(folder)


def rows(frame: DataFrame, *columns: str) -> list[tuple]:
    chosen = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
