"""Exact quantile without gathering the values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarium.functions.columns import magnitude_bucket


def exact_quantile(rows: DataFrame, units: str, q: float, out: str, latest: str | None = None) -> DataFrame:
    """One row: the `q` quantile of a whole-number value (as SQL), linearly interpolated.

    First a histogram over value buckets, whose size is bounded whatever the data
    (see `magnitude_bucket`), shows which bucket holds the two neighbouring
    ranks; then only that bucket's distinct values are walked.
    `percentile()` gives the same number but holds every distinct value in one task.
    The maximum of a column `latest` over all these rows is taken along.
    """
    # Both steps start from these counts, so that `rows` is computed once: the
    # second use reads the first one's shuffle again.
    counts = (
        rows.selectExpr(f"{units} AS _units", f"{latest or 'NULL'} AS _latest")
        .filter("_units IS NOT NULL")
        .groupBy("_units")
        .agg(F.count("*").alias("_n"), F.max("_latest").alias("_latest"))
        .withColumn("_bucket", magnitude_bucket("_units"))
    )
    histogram = (
        counts.groupBy("_bucket")
        .agg(F.sum("_n").alias("_n"), F.max("_latest").alias("_latest"))
        .selectExpr(
            "_bucket",
            "_n",
            "sum(_n) OVER (ORDER BY _bucket ROWS UNBOUNDED PRECEDING) AS _upto",
            f"(sum(_n) OVER () - 1) * {q!r}D AS _position",
            "max(_latest) OVER () AS _overall",
        )
        .withColumn("_rank", F.floor("_position"))
    )
    # Rank r (from 0) lies in the bucket where before <= r < upto: at most two buckets.
    target = histogram.filter("_upto > _rank AND _upto - _n <= _rank + 1").selectExpr(
        "_bucket", "_rank", "_position", "_overall", "_upto - _n AS _before"
    )
    upto = "_before + sum(_n) OVER (PARTITION BY _bucket ORDER BY _units ROWS UNBOUNDED PRECEDING)"
    near = counts.join(F.broadcast(target), "_bucket").withColumn("_upto", F.expr(upto))
    ends = near.agg(
        F.expr("min(CASE WHEN _upto > _rank THEN _units END)").alias("low"),
        F.expr("min(CASE WHEN _upto > _rank + 1 THEN _units END)").alias("high"),
        F.expr("max(_position - _rank)").alias("part"),
        # Both, so that both uses ask for the same columns of the counts.
        F.expr("greatest(max(_overall), max(_latest))").alias("latest"),
    )
    found = [f"low + (coalesce(high, low) - low) * part AS {out}"]
    return ends.selectExpr(*found, *([f"latest AS {latest}"] if latest else []))
