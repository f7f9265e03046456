"""Headline metrics: one-row frames, one per block of the report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarium.contracts import Model
from bazaarium.functions.columns import ratio
from bazaarium.plans import marts
from bazaarium.plans.marts import delivered_orders, low_review_rate

AT_RISK = "At-risk high-value"


@dataclass(frozen=True)
class HeadlineParameters:
    """What the report compares. The defaults are the published report's choices."""

    prior_year: int = 2017
    current_year: int = 2018
    first_month: int = 1
    last_month: int = 7
    retention_days: int = 90
    named_states: Sequence[str] = ("SP", "RJ", "BA")
    top_states: int = 3


def overall(model: Model) -> DataFrame:
    orders = delivered_orders(model)
    repeat = F.when(F.col("customer_delivered_order_number") > 1, F.col("item_gmv")).otherwise(0)
    totals = orders.agg(
        F.min("order_purchase_timestamp").alias("first_purchase_timestamp"),
        F.max("order_purchase_timestamp").alias("last_purchase_timestamp"),
        F.count("order_id").alias("delivered_orders"),
        F.count_distinct("customer_unique_id").alias("observed_customers"),
        F.sum("item_gmv").alias("delivered_gmv_brl"),
        F.sum("freight_value").alias("freight_brl"),
        F.sum("amount_paid").alias("amount_paid_brl"),
        F.sum("item_count").alias("delivered_items"),
        F.avg("on_time_flag").alias("on_time_delivery_rate"),
        F.avg("delivery_days").alias("average_delivery_days"),
        F.avg("review_score").alias("average_review_score"),
        low_review_rate(),
        F.sum(repeat).alias("_repeat_gmv"),
    )
    gmv = F.col("delivered_gmv_brl")
    return totals.select(
        "first_purchase_timestamp",
        "last_purchase_timestamp",
        "delivered_orders",
        "observed_customers",
        "delivered_gmv_brl",
        "freight_brl",
        "amount_paid_brl",
        ratio(gmv, F.col("delivered_orders")).alias("average_order_value_brl"),
        "delivered_items",
        "on_time_delivery_rate",
        "average_delivery_days",
        "average_review_score",
        "low_review_rate",
        ratio(F.col("_repeat_gmv"), gmv).alias("repeat_order_gmv_share"),
    )


def repeat(model: Model) -> DataFrame:
    """Repeat customers' GMV counts all their orders, the first one included."""
    again = F.col("delivered_orders") >= 2
    totals = marts.customer_lifecycle(model).agg(
        F.count("*").alias("observed_customers"),
        F.count_if(again).alias("repeat_customers"),
        F.sum(F.when(again, F.col("observed_gmv_brl")).otherwise(0)).alias("_repeat_gmv"),
        F.sum("observed_gmv_brl").alias("_gmv"),
    )
    return totals.select(
        "observed_customers",
        "repeat_customers",
        ratio(F.col("repeat_customers"), F.col("observed_customers")).alias("repeat_customer_rate"),
        ratio(F.col("_repeat_gmv"), F.col("_gmv")).alias("repeat_customer_gmv_share"),
    )


def growth(model: Model, parameters: HeadlineParameters = HeadlineParameters()) -> DataFrame:
    """Same months of two years: the filter is on month keys, so stored months are pruned."""
    years = (parameters.prior_year, parameters.current_year)
    months = range(parameters.first_month, parameters.last_month + 1)
    keys = [f"{year:04d}-{month:02d}" for year in years for month in months]
    per_year = (
        delivered_orders(model)
        .filter(F.col("purchase_month").isin(keys))
        .groupBy(F.substring("purchase_month", 1, 4).cast("int").alias("year"))
        .agg(
            F.count("order_id").alias("orders"),
            F.count_distinct("customer_unique_id").alias("customers"),
            F.sum("item_gmv").alias("gmv"),
        )
    )

    def of(year: int, column: str) -> Column:
        return F.max(F.when(F.col("year") == year, F.col(column)))

    prior, current = years
    both = per_year.agg(
        of(prior, "orders").alias("orders_prior"),
        of(current, "orders").alias("orders_current"),
        of(prior, "gmv").alias("gmv_prior"),
        of(current, "gmv").alias("gmv_current"),
        of(prior, "customers").alias("_customers_prior"),
        of(current, "customers").alias("_customers_current"),
    )
    return both.select(
        "orders_prior",
        "orders_current",
        (ratio(F.col("orders_current"), F.col("orders_prior")) - 1).alias("orders_growth"),
        "gmv_prior",
        "gmv_current",
        (ratio(F.col("gmv_current"), F.col("gmv_prior")) - 1).alias("gmv_growth"),
        (ratio(F.col("_customers_current"), F.col("_customers_prior")) - 1).alias("customer_growth"),
    )


def delivery(model: Model) -> DataFrame:
    """Late against on-time orders, as one row."""
    groups = marts.delivery_experience(model)

    def of(group: str, column: str) -> Column:
        return F.max(F.when(F.col("delivery_group") == group, F.col(column)))

    orders = F.sum("delivered_orders")
    late_orders = F.coalesce(of("Late", "delivered_orders"), F.lit(0))
    late_low, on_time_low = of("Late", "low_review_rate"), of("On time or early", "low_review_rate")
    return groups.agg(
        ratio(late_orders, orders).alias("late_order_rate"),
        of("On time or early", "average_review_score").alias("on_time_average_review"),
        of("Late", "average_review_score").alias("late_average_review"),
        on_time_low.alias("on_time_low_review_rate"),
        late_low.alias("late_low_review_rate"),
        ratio(late_low, on_time_low).alias("low_review_rate_multiple_late_vs_on_time"),
    )


def retention(model: Model, parameters: HeadlineParameters = HeadlineParameters()) -> DataFrame:
    days = parameters.retention_days
    return marts.repeat_windows(model, [days]).select(
        F.col("eligible_customers").alias(f"eligible_{days}_day_customers"),
        F.col("repeat_customers").alias(f"repeat_within_{days}_days_customers"),
        F.col("repeat_purchase_rate").alias(f"repeat_within_{days}_days_rate"),
    )


def rfm_opportunity(model: Model) -> DataFrame:
    return (
        marts.rfm_segment_summary(model)
        .filter(F.col("segment") == AT_RISK)
        .select(
            F.col("customers").alias("at_risk_high_value_customers"),
            F.col("customer_share").alias("at_risk_high_value_customer_share"),
            F.col("observed_gmv_brl").alias("at_risk_high_value_gmv_brl"),
            F.col("observed_gmv_share").alias("at_risk_high_value_gmv_share"),
        )
    )


def geography(model: Model, parameters: HeadlineParameters = HeadlineParameters()) -> DataFrame:
    """GMV concentration and the on-time rates of named states, as one row.

    The first named state is the one whose share is reported.
    """
    states = delivered_orders(model).groupBy("customer_state").agg(
        F.sum("item_gmv").alias("gmv"), F.avg("on_time_flag").alias("on_time")
    )
    largest = states.orderBy(F.col("gmv").desc(), "customer_state").limit(parameters.top_states)
    top_gmv = largest.agg(F.sum("gmv")).scalar()

    def of(state: str, column: str) -> Column:
        return F.max(F.when(F.col("customer_state") == state, F.col(column)))

    first = parameters.named_states[0]
    rates = [of(state, "on_time").alias(f"{_slug(state)}_on_time_rate") for state in parameters.named_states]
    row = states.agg(of(first, "gmv").alias("_first"), F.sum("gmv").alias("_all"), *rates)
    return row.select(
        ratio(F.col("_first"), F.col("_all")).alias(f"{_slug(first)}_gmv_share"),
        ratio(top_gmv, F.col("_all")).alias(f"top_{parameters.top_states}_state_gmv_share"),
        *[f"{_slug(state)}_on_time_rate" for state in parameters.named_states],
    )


def _slug(name: str) -> str:
    return name.lower().replace(" ", "_")


def blocks(model: Model, parameters: HeadlineParameters = HeadlineParameters()) -> dict[str, DataFrame]:
    return {
        "overall": overall(model),
        "repeat": repeat(model),
        "growth": growth(model, parameters),
        "delivery": delivery(model),
        "retention": retention(model, parameters),
        "rfm_opportunity": rfm_opportunity(model),
        "geography": geography(model, parameters),
    }
