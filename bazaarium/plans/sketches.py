"""Distinct customers of any period from mergeable sketches, beside the exact counts.

A row of `monthly` holds, for a month and a state, a theta sketch of the customers with a
delivered order. Sketches of any months and states merge into one, and two of them
intersect, so that "active in both" needs no fact either. A cell takes at most
8 * 2^`size` bytes (32 KB at the default), whatever its customers, and the table has a row
for each month and state; it is what the broadcasts and shuffles here carry.

Error bound, with k = 2^`size`: up to k distinct customers a sketch is exact. Above,
an estimate of n lies within 4 * n / sqrt(k - 2) of n, and one of an intersection of b out
of a union of u within 4 * sqrt(b * u / (k - 2)), both with a chance of about 0.9999 (four
standard errors). The estimate may vary with the order of merging, always in that bound.

Customers and months that are null take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarium.contracts import Model
from bazaarium.functions.columns import month_start
from bazaarium.plans.model import DELIVERED

CELL = ("purchase_month", "customer_state")
SIZE = 12
STANDARD_ERRORS = 4


def _delivered(model: Model) -> DataFrame:
    known = F.col("customer_unique_id").isNotNull() & F.col("purchase_month").isNotNull()
    return model.fact_orders.filter((F.col("order_status") == DELIVERED) & known)


def monthly(model: Model, size: int = SIZE) -> DataFrame:
    """(purchase_month, customer_state, customers): the table to store."""
    # Sketches are built in each task before the shuffle, so a hot customer or state ships once a task.
    return _delivered(model).groupBy(*CELL).agg(F.theta_sketch_agg("customer_unique_id", size).alias("customers"))


def merged(cells: DataFrame, by: Sequence[str], size: int = SIZE) -> DataFrame:
    """Sketches of coarser groups, such as states over a period, or all of it (`by` empty)."""
    return cells.groupBy(*by).agg(F.theta_union_agg("customers", size).alias("customers"))


def active(cells: DataFrame, by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """(by, estimated_customers) of the cells that a filter has left."""
    return merged(cells, by, size).select(*by, F.theta_sketch_estimate("customers").alias("estimated_customers"))


def _number(month: str) -> Column:
    start = month_start(F.col(month))
    return F.year(start) * 12 + F.month(start)


def returning(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """(purchase_month, later_month, estimated_both, estimated_either) for any two months, the earlier first.

    A month meets the later ones by their numbers, so there are as many rows as the calendar has pairs.
    """
    months = merged(cells, ["purchase_month"], size).withColumn("number", _number("purchase_month"))
    span = months.agg(F.max("number") - F.min("number")).scalar()
    number = F.col("number")
    asked = months.select(
        "purchase_month",
        F.col("customers").alias("first"),
        F.explode(F.when(span >= 1, F.sequence(number + 1, number + span))).alias("number"),
    )
    later = months.select(F.col("purchase_month").alias("later_month"), "customers", "number")
    met = asked.join(later, "number")
    both = F.theta_sketch_estimate(F.theta_intersection("first", "customers"))
    either = F.theta_sketch_estimate(F.theta_union("first", "customers", size))
    return met.select("purchase_month", "later_month", both.alias("estimated_both"), either.alias("estimated_either"))


def bound(customers: Column, of: Column | None = None, size: int = SIZE) -> Column:
    """How far an estimate may lie from `customers`; `of`: the union that an intersection was taken from."""
    whole = customers if of is None else of
    return F.when(whole > F.lit(1 << size), STANDARD_ERRORS * F.sqrt(customers * whole / F.lit((1 << size) - 2))).otherwise(0.0)


def _exact(model: Model, by: Sequence[str]) -> DataFrame:
    people = _delivered(model).groupBy(*by, "customer_unique_id").agg(F.count("*").alias("n"))
    return people.groupBy(*by).agg(F.count("*").alias("active_customers"))


def active_by_state(model: Model, cells: DataFrame, size: int = SIZE) -> DataFrame:
    """Exact customers of each state over all months, with the estimate's distance held against the bound."""
    estimated = active(cells, ["customer_state"], size).withColumnRenamed("customer_state", "state")
    met = _exact(model, ["customer_state"]).join(estimated, F.expr("customer_state <=> state"), "left").drop("state")
    return _judged(met, "active_customers", "estimated_customers", None, size)


def _judged(rows: DataFrame, exact: str, estimate: str, of: Column | None, size: int) -> DataFrame:
    apart = F.abs(F.col(estimate) - F.col(exact))
    return rows.withColumn("within_bound", F.coalesce(apart <= bound(F.col(exact), of, size), F.lit(False)))


def returning_by_month(model: Model, cells: DataFrame, size: int = SIZE) -> DataFrame:
    """Exact customers active in both of two months, with the estimate's distance held against the bound.

    A customer has one row for each month, so even one with a third of all orders meets
    itself no more often than the calendar has pairs of months.
    """
    people = _delivered(model).groupBy("customer_unique_id", "purchase_month").agg(F.count("*").alias("n"))
    first = people.select("customer_unique_id", "purchase_month")
    later = people.select("customer_unique_id", F.col("purchase_month").alias("later_month"))
    pairs = first.join(later, "customer_unique_id").filter(F.col("purchase_month") < F.col("later_month"))
    exact = pairs.groupBy("purchase_month", "later_month").agg(F.count("*").alias("returning_customers"))
    met = returning(cells, size).join(exact, ["purchase_month", "later_month"], "left").fillna(0, ["returning_customers"])
    return _judged(met, "returning_customers", "estimated_both", F.col("estimated_either"), size)
