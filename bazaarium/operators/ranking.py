"""Exact numbering and ranking that never puts one hot group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarium.functions.columns import magnitude_bucket
from bazaarium.operators.skew import HotKeys, mark_hot

_BELOW_ALL = -(1 << 62)


def _chunked(marked: DataFrame, keys: Sequence[str], chunks: Sequence[Column], hot: HotKeys) -> DataFrame:
    """Add `_chunk` to the rows of hot keys, cut as finely as their counts ask for.

    A chunk of one level that still holds more rows than a task should is cut by the
    next level. Such chunks are few: each holds over `rows_per_task` rows.
    """
    found, levels = marked.withColumn("_c0", F.when(F.col("_rows").isNotNull(), chunks[0])), ["_c0"]
    for number, finer in enumerate(chunks[1:], start=1):
        crowded = (
            found.filter(F.col(levels[-1]).isNotNull())
            .groupBy(*keys, *levels)
            .agg(F.count("*").alias("_held"))
            .filter(F.col("_held") > hot.policy.rows_per_task)
        )
        level = f"_c{number}"
        found = found.join(crowded, [*keys, *levels], "left")
        found = found.withColumn(level, F.when(F.col("_held").isNotNull(), finer)).drop("_held")
        levels.append(level)
    return found.withColumn("_chunk", F.when(F.col("_c0").isNotNull(), F.struct(*levels))).drop(*levels)


def number_within(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunks: Sequence[Column],
    hot: HotKeys | None,
    out: str,
    any_missing: bool = True,
) -> DataFrame:
    """`row_number()` over `keys` in `order`, as column `out`.

    `hot` lists the hot values of `keys[0]`, if any. Their rows are cut into chunks by
    `chunks`, from coarse to fine: never-null expressions of which each does not
    decrease along `order` where the ones before it are equal. Every chunk is numbered
    on its own and shifted by the number of rows in the chunks before it. All other
    keys are numbered in one go. Rows whose first key is null are no group: they are
    spread by the first level, and their number means nothing. Where a caller knows that
    there are none (`any_missing`), rows without hot keys are shuffled by the keys alone, and what
    follows by the same keys needs no further shuffle.
    """
    first, nobody = keys[0], F.col(keys[0]).isNull()
    if hot is None and not any_missing:
        plain = Window.partitionBy(*keys).orderBy(*order)
        numbered = rows.withColumn("_position", F.row_number().over(plain))
        return numbered.selectExpr(*rows.columns, f"CAST(_position AS BIGINT) AS {out}")
    if hot is None:
        spread = F.when(nobody, chunks[0])
        plain = Window.partitionBy(*keys, "_chunk").orderBy(*order)
        numbered = rows.withColumn("_chunk", spread).withColumn("_position", F.row_number().over(plain))
        return numbered.selectExpr(*rows.columns, f"CAST(_position AS BIGINT) AS {out}")

    chunked = _chunked(mark_hot(rows, hot), keys, chunks, hot)
    within = Window.partitionBy(*keys, "_chunk", F.when(nobody, chunks[0])).orderBy(*order)
    numbered = chunked.withColumn("_position", F.row_number().over(within))
    # One row per hot group and chunk. The last groupBy changes nothing but tells
    # the optimizer that its keys are unique, so an unused number costs nothing.
    before = F.expr(
        f"""coalesce(sum(count(*)) OVER (PARTITION BY {", ".join(keys)} ORDER BY _chunk
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"""
    )
    only_hot = rows.join(hot.hinted(), first)
    shifts = (
        _chunked(only_hot, keys, chunks, hot)
        .groupBy(*keys, "_chunk")
        .agg(before.alias("_before"))
        .groupBy(*keys, "_chunk")
        .agg(F.max("_before").alias("_before"))
    )
    return numbered.join(shifts, [*keys, "_chunk"], "left").selectExpr(
        *rows.columns, f"CAST(_position + coalesce(_before, 0) AS BIGINT) AS {out}"
    )


def dense_rank_descending(rows: DataFrame, units: str, out: str) -> DataFrame:
    """`dense_rank()` of all rows by a whole-number value (as SQL), largest first, nulls last.

    A window without partitions would sort every row in one task. Here rows are ranked
    inside value buckets, and each bucket is shifted by the distinct values above it.
    The per-bucket table has a fixed maximum size (see `magnitude_bucket`), so its
    one-task running sum and its broadcast are bounded.
    """
    valued = rows.withColumn("_units", F.expr(f"coalesce({units}, {_BELOW_ALL})")).withColumn(
        "_bucket", magnitude_bucket("_units")
    )
    higher = F.expr(
        """coalesce(sum(count(DISTINCT _units)) OVER (ORDER BY _bucket DESC
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"""
    )
    shifts = valued.groupBy("_bucket").agg(higher.alias("_above"))
    inside = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(F.col("_units").desc()))
    ranked = valued.withColumn("_inside", inside).join(F.broadcast(shifts), "_bucket")
    return ranked.selectExpr(*rows.columns, f"_inside + _above AS {out}")
