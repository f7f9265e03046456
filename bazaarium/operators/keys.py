"""Key checks. Every one aggregates on the map side first, so hot keys are harmless."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def surplus_rows(rows: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """One row: how many rows repeat an earlier key. Null keys count as equal."""
    per_key = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(out))


def orphan_rows(rows: DataFrame, key: str, parents: DataFrame, out: str) -> DataFrame:
    """One row: how many rows refer to a parent that does not exist.

    Rows are counted per key before the anti-join, which then moves one row per
    distinct key and needs no further shuffle on this side.
    """
    per_key = rows.groupBy(key).agg(F.count("*").alias("n"))
    missing = per_key.join(parents.select(key), key, "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(out))


def reference_checks(
    parents: DataFrame, rows: DataFrame, key: str, surplus: str, orphans: str, counts: Column, sums: Mapping[str, Column] = {}
) -> DataFrame:
    """One row: surplus parents of a key, rows without a parent, and sums over all rows.

    Both sides are counted by key in one aggregate and are not joined: what is shuffled is,
    for each task, one row of counts for each key. A null key has no parent, and repeated
    null keys of parents are surplus. `counts`: how many rows one of `rows` stands for.
    """
    none = F.lit(0).cast("bigint")
    names = [f"_{place}" for place in range(len(sums))]
    own = parents.select(key, F.lit(1).cast("bigint").alias("_parents"), none.alias("_rows"), *[none.alias(n) for n in names])
    referring = rows.select(
        key, none.alias("_parents"), counts.cast("bigint").alias("_rows"), *[c.cast("bigint").alias(n) for n, c in zip(names, sums.values())]
    )
    per_key = own.unionByName(referring).groupBy(key).agg(*[F.sum(n).alias(n) for n in ("_parents", "_rows", *names)])
    found = {
        surplus: F.sum(F.greatest(F.col("_parents") - 1, none)),
        orphans: F.sum(F.when((F.col("_parents") == 0) | F.col(key).isNull(), F.col("_rows"))),
        **{name: F.sum(place) for name, place in zip(sums, names)},
    }
    return per_key.agg(*[F.coalesce(value, none).alias(name) for name, value in found.items()])
