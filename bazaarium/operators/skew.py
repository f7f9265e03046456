"""Finding hot keys and joining through them without one overloaded task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Heavy cells that may be broadcast: a few MB, held by the driver.
LOCAL_CELLS = 100_000


@dataclass(frozen=True)
class SkewPolicy:
    """A key is hot above `rows_per_task` rows, whatever its share of all rows.

    Up to `local_keys` hot keys are kept as a constant and broadcast; a longer list
    stays a distributed table that is joined by shuffle.
    """

    rows_per_task: int = 1_000_000
    local_keys: int = 10_000


@dataclass(frozen=True)
class HotKeys:
    """`rows`: the hot values of `key` with their number of rows, `_rows`."""

    rows: DataFrame
    key: str
    local: bool
    policy: SkewPolicy

    def hinted(self) -> DataFrame:
        return F.broadcast(self.rows) if self.local else self.rows

    def tasks(self) -> Column:
        """Over how many tasks the rows of a marked key are spread."""
        return F.ceil(F.col("_rows") / F.lit(max(self.policy.rows_per_task, 1))).cast("int")


def heavy_cells(rows: DataFrame, key: str, cells: int, policy: SkewPolicy) -> DataFrame:
    """Hash cells of the key that hold more rows than a task should.

    What is shuffled is one count for each cell and task, not a row for each key. All
    keys outside these cells are certainly not hot. Each heavy cell holds over
    `rows_per_task` rows, which bounds their number.
    """
    return (
        rows.groupBy(_cell(key, cells).alias("_cell"))
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") > policy.rows_per_task)
        .select("_cell")
    )


def _cell(key: str, cells: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(cells)).cast("int")


def hot_keys(rows: DataFrame, key: str, policy: SkewPolicy) -> HotKeys | None:
    """The hot values of `key` with exact counts, or None if there are none.

    Like gathering a statistic before planning: with nothing hot, the plans built on it
    are the plain ones. One scan counts rows per hash cell, a second one counts the keys
    of heavy cells exactly. There are at least four times as many cells as hot keys can
    exist, so few other keys are counted with them. Where more cells can be heavy than the
    driver should hold, all keys are counted at once, combined on the map side.
    """
    present = rows.filter(F.col(key).isNotNull()).select(key)
    total = present.count()
    if total <= policy.rows_per_task:
        return None
    suspects, heaviest = present, total // max(policy.rows_per_task, 1)
    if heaviest <= LOCAL_CELLS:
        cells = 1 << max(12, (4 * heaviest).bit_length())
        heavy = heavy_cells(present, key, cells, policy)
        suspects = present.withColumn("_cell", _cell(key, cells)).join(F.broadcast(heavy), "_cell", "left_semi")
    hot = suspects.groupBy(key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > policy.rows_per_task)
    found = hot.limit(policy.local_keys + 1).toArrow()
    if not found.num_rows:
        return None
    if found.num_rows > policy.local_keys:
        return HotKeys(hot, key, False, policy)
    return HotKeys(rows.sparkSession.createDataFrame(found, hot.schema), key, True, policy)


def mark_hot(rows: DataFrame, hot: HotKeys) -> DataFrame:
    """Add `_rows`, the count of a hot key's rows, and null for others."""
    return rows.join(hot.hinted(), hot.key, "left")


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    spread: Sequence[str],
    hot: HotKeys | None,
    how: str = "left",
) -> DataFrame:
    """Equi-join of many `rows` to a `lookup` that holds each key at most once.

    Rows of a hot key are spread over as many shuffle keys as its count asks for, by a
    hash of their own `spread` columns (so a retried task repeats the choice), and only
    the hot lookup rows are copied to all of them. Other keys join as usual.
    """
    if hot is None:
        return rows.join(lookup, key, how)
    salt = F.pmod(F.xxhash64(*spread), hot.tasks().cast("bigint")).cast("int")
    spread_rows = mark_hot(rows, hot).select(
        *rows.columns, F.coalesce(salt, F.lit(0)).alias("_salt")
    )
    last_salt = F.coalesce(hot.tasks() - 1, F.lit(0))
    copied = mark_hot(lookup, hot).select(
        *lookup.columns, F.explode(F.sequence(F.lit(0), last_salt)).alias("_salt")
    )
    return spread_rows.join(copied, [key, "_salt"], how).drop("_salt")
