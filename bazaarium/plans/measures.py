"""Measures that answer to a selection, as a report's slicers would set it.

Filters flow one way. Period, order state and customer segment select orders, and
through them items. Category, product, seller and the customer's home location
select items only and never reach order-level measures. An item row carries its
order's date, state, status and customer, so order filters are applied to the item
table directly: no join, and stored months are pruned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarium.contracts import Model
from bazaarium.functions.columns import ratio
from bazaarium.operators.skew import SkewPolicy, hot_keys, salted_join
from bazaarium.plans.marts import delivered_sales
from bazaarium.plans.model import DELIVERED, LOW_REVIEW_MAX

# Inclusive first and last purchase date.
Period = tuple[date, date]


@dataclass(frozen=True)
class Selection:
    """None means no filter. `home_*` are the customer's latest location."""

    period: Period | None = None
    states: Sequence[str] | None = None
    segments: Sequence[str] | None = None
    categories: Sequence[str] | None = None
    products: Sequence[object] | None = None
    sellers: Sequence[object] | None = None
    home_states: Sequence[str] | None = None
    home_cities: Sequence[str] | None = None

    def without(self, *names: str) -> Selection:
        return replace(self, **dict.fromkeys(names))

    def selects_items(self) -> bool:
        chosen = (self.categories, self.products, self.sellers, self.home_states, self.home_cities)
        return any(values is not None for values in chosen)


def _in_period(period: Period) -> Column:
    """The month bounds say nothing new, but stored tables are partitioned by month."""
    first, last = period
    by_day = F.col("purchase_date").between(F.lit(first), F.lit(last))
    return by_day & F.col("purchase_month").between(f"{first:%Y-%m}", f"{last:%Y-%m}")


def _of_customers(
    rows: DataFrame, customers: DataFrame, model: Model, fact: str, policy: SkewPolicy
) -> DataFrame:
    """Rows of a fact that belong to the given distinct customers.

    One of them may own most rows of that fact. Who does is counted once for a model,
    on the fact itself: a customer with few orders may have very many items.
    """
    key = "customer_unique_id"
    hot = model.fact(("hot", fact, key, policy), lambda: hot_keys(getattr(model, fact), key, policy))
    return salted_join(rows, customers.select(key), key, ["order_id"], hot, how="left_semi")


def _order_filters(
    rows: DataFrame, model: Model, selection: Selection, fact: str, policy: SkewPolicy
) -> DataFrame:
    if selection.period is not None:
        rows = rows.filter(_in_period(selection.period))
    if selection.states is not None:
        rows = rows.filter(F.col("customer_state").isin(list(selection.states)))
    if selection.segments is not None:
        chosen = model.mart_customer_rfm.filter(F.col("segment").isin(list(selection.segments)))
        rows = _of_customers(rows, chosen, model, fact, policy)
    return rows


def select_orders(model: Model, selection: Selection, policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Delivered orders in the selection."""
    delivered = model.fact_orders.filter(F.col("order_status") == DELIVERED)
    return _order_filters(delivered, model, selection, "fact_orders", policy)


def select_sales(model: Model, selection: Selection, policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Items of delivered orders in the selection."""
    rows = _order_filters(delivered_sales(model), model, selection, "fact_sales", policy)
    lists = {
        "product_category_name_english": selection.categories,
        "product_id": selection.products,
        "seller_id": selection.sellers,
    }
    for column, values in lists.items():
        if values is not None:
            rows = rows.filter(F.col(column).isin(list(values)))
    home = model.dim_customer
    if selection.home_states is not None:
        home = home.filter(F.col("customer_state").isin(list(selection.home_states)))
    if selection.home_cities is not None:
        home = home.filter(F.col("customer_city").isin(list(selection.home_cities)))
    if home is not model.dim_customer:
        rows = _of_customers(rows, home, model, "fact_sales", policy)
    return rows


def _order_measures() -> dict[str, Column]:
    """Aggregates of delivered orders. Scores and flags are null when unknown, and
    both sides of a rate leave them out."""
    on_time, score = F.col("on_time_flag"), F.col("review_score")
    return {
        "delivered_orders": F.count("order_id"),
        "active_customers": F.count_distinct("customer_unique_id"),
        "delivery_evaluable_orders": F.count("on_time_flag"),
        "on_time_delivered_orders": F.count_if(on_time == 1),
        "on_time_delivery_rate": ratio(F.count_if(on_time == 1), F.count("on_time_flag")),
        "reviewed_delivered_orders": F.count("review_score"),
        "low_review_delivered_orders": F.count_if(score <= LOW_REVIEW_MAX),
        "low_review_rate": ratio(F.count_if(score <= LOW_REVIEW_MAX), F.count("review_score")),
        "freight_to_gmv_ratio": ratio(F.sum("freight_value"), F.sum("item_gmv")),
        "average_delivery_days": F.avg("delivery_days"),
        "average_review_score": F.avg("review_score"),
    }


def totals(model: Model, selection: Selection = Selection()) -> DataFrame:
    """All card measures of a selection, as one row. GMV comes from the items."""
    gmv = select_sales(model, selection).agg(F.sum("price")).scalar()
    cards = select_orders(model, selection).agg(*[m.alias(n) for n, m in _order_measures().items()])
    aov = ratio(F.col("delivered_gmv"), F.col("delivered_orders"))
    return cards.withColumn("delivered_gmv", gmv).withColumn("delivered_aov", aov)


def repeat_rate(model: Model, selection: Selection = Selection(), by: Sequence[str] = ()) -> DataFrame:
    """Customers with two or more orders inside the selection, and inside each group."""
    per_customer = (
        select_orders(model, selection)
        .filter("customer_unique_id IS NOT NULL")
        .groupBy(*by, "customer_unique_id")
        .agg(F.count("*").alias("orders"))
    )
    counted = per_customer.groupBy(*by).agg(
        F.count("*").alias("active_customers"),
        F.count_if(F.col("orders") >= 2).alias("repeat_customers"),
    )
    rate = ratio(F.col("repeat_customers"), F.col("active_customers"))
    return counted.withColumn("repeat_customer_rate", rate)


def _period_name(prior: Period, current: Period) -> Column:
    return F.when(_in_period(prior), "prior").when(_in_period(current), "current")


def growth(
    model: Model,
    prior: Period,
    current: Period,
    selection: Selection = Selection(),
    by: Sequence[str] = ("customer_state",),
) -> DataFrame:
    """Growth between two fixed periods. The selection's own period is ignored, the
    rest of it is kept. Each fact is read once for both periods.

    A group that has nothing in the current period has lost all it had, a rate of -1.
    One that had nothing in the prior period has no rate.
    """
    kept = selection.without("period")
    either = _in_period(prior) | _in_period(current)
    period = _period_name(prior, current).alias("period")
    orders = (
        select_orders(model, kept)
        .filter(either)
        .groupBy(*by, period)
        .agg(
            F.count("order_id").alias("orders"),
            F.count_distinct("customer_unique_id").alias("customers"),
            F.lit(None).cast("decimal(38,2)").alias("gmv"),
        )
    )
    sales = (
        select_sales(model, kept)
        .filter(either)
        .groupBy(*by, period)
        .agg(
            F.lit(None).cast("bigint").alias("orders"),
            F.lit(None).cast("bigint").alias("customers"),
            F.sum("price").cast("decimal(38,2)").alias("gmv"),
        )
    )

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("period") == name, F.col(column)))

    names = ("orders", "customers", "gmv")
    sides = orders.unionByName(sales).groupBy(*by).agg(
        *[of(side, name).alias(f"{side}_{name}") for side in ("prior", "current") for name in names]
    )
    for side in ("prior", "current"):
        sides = sides.withColumn(f"{side}_aov", ratio(F.col(f"{side}_gmv"), F.col(f"{side}_orders")))
    labels = {"gmv": "gmv_growth", "orders": "orders_growth", "customers": "customer_growth", "aov": "aov_growth"}
    rates = [
        ratio(
            F.coalesce(F.col(f"current_{name}").cast("double"), F.lit(0.0)) - F.col(f"prior_{name}").cast("double"),
            F.col(f"prior_{name}"),
        ).alias(label)
        for name, label in labels.items()
    ]
    return sides.select(*by, *rates)


def growth_drivers(
    model: Model, prior: Period, current: Period, selection: Selection = Selection()
) -> DataFrame:
    """The four growth rates as labelled rows."""
    rates = growth(model, prior, current, selection, by=())
    return rates.unpivot([], rates.columns, "growth_metric", "growth_rate")


def state_vs_benchmark(model: Model, selection: Selection = Selection()) -> DataFrame:
    """On-time rate of each selected state beside the rate of all states."""
    rate = ratio(F.count_if(F.col("on_time_flag") == 1), F.count("on_time_flag"))
    every_state = select_orders(model, selection.without("states")).agg(rate).scalar()
    return (
        select_orders(model, selection)
        .groupBy("customer_state")
        .agg(F.count("order_id").alias("delivered_orders"), rate.alias("on_time_delivery_rate"))
        .withColumn("overall_on_time_benchmark", every_state)
    )


def first_repeat_gmv(model: Model, selection: Selection = Selection()) -> DataFrame:
    """GMV of first and of later orders by their place in the customer's history,
    which the selection does not renumber."""
    flag = "first_observed_delivered_order_flag"
    orders = select_orders(model, selection)
    if selection.selects_items():
        # Items are summed per order first, so the join is one row to one row.
        sold = select_sales(model, selection).groupBy("order_id").agg(F.sum("price").alias("gmv"))
        value = orders.select("order_id", flag).join(sold, "order_id")
    else:
        value = orders.select(flag, F.col("item_gmv").alias("gmv"))
    first = F.col(flag) == 1
    return value.agg(
        F.sum(F.when(first, F.col("gmv"))).alias("first_order_gmv"),
        F.sum(F.when(~first, F.col("gmv"))).alias("repeat_order_gmv"),
    )


def observed_repeat_pct(model: Model) -> DataFrame:
    """Whole-history share of repeat customers; no selection applies."""
    again = (F.col("frequency") >= 2).cast("int")
    return model.mart_customer_rfm.agg(F.avg(again).alias("observed_repeat_customer_pct"))


def top_categories(model: Model, selection: Selection = Selection(), places: int = 10) -> DataFrame:
    gmv = F.sum("price").alias("delivered_gmv")
    category = F.col("product_category_name_english").alias("category")
    return (
        select_sales(model, selection)
        .groupBy(category)
        .agg(gmv)
        .orderBy(F.col("delivered_gmv").desc(), "category")
        .limit(places)
    )


def top_states(model: Model, selection: Selection = Selection(), places: int = 7) -> DataFrame:
    return (
        select_sales(model, selection)
        .groupBy("customer_state")
        .agg(F.sum("price").alias("delivered_gmv"))
        .orderBy(F.col("delivered_gmv").desc(), "customer_state")
        .limit(places)
    )
