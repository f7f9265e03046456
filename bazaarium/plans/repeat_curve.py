"""Second purchases within N days, for every N from one pass over the customers.

A customer who was followed for F whole days and came back after W days (rounded up)
counts as eligible for each window up to F, and as repeating for each from W to F. Both
are ranges of N, so a customer changes the curve at three days only. `steps` adds these
changes up by day: a table with one row for a day, bounded by the calendar and not by the
customers, that can be stored and added to others. Its running sums are the curve, and any
window is a lookup in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarium.contracts import Model
from bazaarium.functions.columns import MICROS_PER_DAY, ratio
from bazaarium.plans.marts import REPEAT_WINDOWS, waiting_times


def steps(model: Model) -> DataFrame:
    """`(day, eligible, repeating)`: by how much the curve rises at a day; day 0 holds the start.

    A window that a customer was followed for exactly, or came back at the end of, counts.
    Who has no purchase time was never followed and takes no part.
    """
    customers = (
        waiting_times(model)
        .filter("followed IS NOT NULL")
        .select(
            F.expr(f"CAST(followed DIV {MICROS_PER_DAY} AS INT) AS followed"),
            F.expr(f"CAST((waited + {MICROS_PER_DAY - 1}) DIV {MICROS_PER_DAY} AS INT) AS waited"),
        )
        .groupBy("followed", "waited")
        .agg(F.count("*").alias("n"))
    )
    after = F.col("followed") + 1
    back = F.coalesce(F.col("waited") <= F.col("followed"), F.lit(False))
    none, n = F.lit(0).cast("bigint"), F.col("n")

    def change(day, eligible, repeating):
        return F.struct(day.alias("day"), eligible.alias("eligible"), repeating.alias("repeating"))

    changes = F.array(
        change(F.lit(0), n, none),
        change(after, -n, none),
        change(F.when(back, F.col("waited")), none, n),
        change(F.when(back, after), none, -n),
    )
    return (
        customers.select(F.inline(changes))
        .filter("day IS NOT NULL")
        .groupBy("day")
        .agg(F.sum("eligible").alias("eligible"), F.sum("repeating").alias("repeating"))
    )


def curve(changes: DataFrame) -> DataFrame:
    """One row for each window from 0 days to the longest that a customer was followed for.

    The running sum is over days, of which there are as many as the calendar has.
    """
    days = changes.agg(F.max("day").alias("last")).select(
        F.explode(F.expr("sequence(0, last - 1)")).alias("day")
    )
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = days.join(changes, "day", "left").select(
        F.col("day").alias("window_days"),
        F.sum(F.coalesce("eligible", F.lit(0))).over(so_far).alias("eligible_customers"),
        F.sum(F.coalesce("repeating", F.lit(0))).over(so_far).alias("repeat_customers"),
    )
    rate = ratio(F.col("repeat_customers"), F.col("eligible_customers"))
    return summed.withColumn("repeat_purchase_rate", rate)


def repeat_curve(model: Model) -> DataFrame:
    return curve(steps(model))


def windows_of(found: DataFrame, windows: Sequence[int] = REPEAT_WINDOWS) -> DataFrame:
    """Some windows of a curve; longer than any customer was followed for, nobody is eligible."""
    spark = found.sparkSession
    wanted = spark.range(1).select(F.explode(F.lit([int(w) for w in windows])).alias("window_days"))
    known = wanted.join(found, "window_days", "left").fillna(0, ["eligible_customers", "repeat_customers"])
    return known.filter(found.agg(F.count("*")).scalar() > 0).select(*found.columns)
