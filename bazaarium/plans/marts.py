"""Business marts. Each is a function of the model and covers delivered orders.

Orders are counted by rows: `fact_orders` holds an order once (a gate checks it), and
a distinct count of a unique key would cost a second shuffle for the same number.
Windows over a whole frame appear only after an aggregate to months, payment types,
segments or delivery groups, whose number does not grow with the orders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarium.contracts import Model, Sources
from bazaarium.functions.columns import (
    MICROS_PER_DAY,
    elapsed_days,
    elapsed_micros,
    month_index,
    ratio,
)
from bazaarium.plans.model import DELIVERED

REPEAT_WINDOWS = (30, 60, 90, 180, 365)
HIGH_REVIEW_MIN = 4


def delivered_orders(model: Model) -> DataFrame:
    return model.fact_orders.filter(F.col("order_status") == DELIVERED)


def delivered_sales(model: Model) -> DataFrame:
    return model.fact_sales.filter(F.col("order_status") == DELIVERED)


def previous_month(column: str) -> Column:
    """The value of the month before among the months present."""
    return F.lag(column).over(Window.orderBy("purchase_month"))


def total(column: str) -> Column:
    return F.sum(column).over(Window.partitionBy())


def low_review_rate() -> Column:
    """The flag is null without a review, so the mean covers reviewed orders only."""
    return F.avg("low_review_flag").alias("low_review_rate")


def _change(now: str, before: Column) -> Column:
    return ratio(F.col(now) - before, before)


def executive_monthly(model: Model) -> DataFrame:
    """One row per month with orders; change is against the previous month present."""
    first = F.col("first_observed_delivered_order_flag") == 1
    gmv, orders = F.col("delivered_gmv_brl"), F.col("delivered_orders")
    monthly = delivered_orders(model).groupBy("purchase_month").agg(
        F.count("order_id").alias("delivered_orders"),
        F.count_distinct("customer_unique_id").alias("active_customers"),
        F.sum("item_gmv").alias("delivered_gmv_brl"),
        F.sum("freight_value").alias("freight_brl"),
        F.sum(F.when(first, F.col("item_gmv")).otherwise(0)).alias("first_order_gmv_brl"),
        F.sum(F.when(~first, F.col("item_gmv")).otherwise(0)).alias("repeat_order_gmv_brl"),
        F.avg("on_time_flag").alias("on_time_delivery_rate"),
        F.avg("review_score").alias("average_review_score"),
    )
    return monthly.select(
        "purchase_month",
        "delivered_orders",
        "active_customers",
        "delivered_gmv_brl",
        "freight_brl",
        ratio(gmv, orders).alias("average_order_value_brl"),
        ratio(orders, F.col("active_customers")).alias("purchase_frequency"),
        ratio(F.col("freight_brl"), gmv).alias("freight_to_gmv_ratio"),
        "first_order_gmv_brl",
        "repeat_order_gmv_brl",
        ratio(F.col("repeat_order_gmv_brl"), gmv).alias("repeat_order_gmv_share"),
        "on_time_delivery_rate",
        "average_review_score",
        _change("delivered_gmv_brl", previous_month("delivered_gmv_brl")).alias("gmv_mom_rate"),
        _change("delivered_orders", previous_month("delivered_orders")).alias("orders_mom_rate"),
    )


def customer_lifecycle(model: Model) -> DataFrame:
    """One row per customer; GMV stays null when no delivered order has items."""
    number, purchased = F.col("customer_delivered_order_number"), F.col("order_purchase_timestamp")
    per_customer = delivered_orders(model).groupBy("customer_unique_id").agg(
        F.min(purchased).alias("first_purchase_timestamp"),
        F.max(purchased).alias("last_purchase_timestamp"),
        F.count("order_id").alias("delivered_orders"),
        F.sum("item_gmv").alias("observed_gmv_brl"),
        F.min(F.when(number == 1, purchased)).alias("_first"),
        F.min(F.when(number == 2, purchased)).alias("_second"),
    )
    days = elapsed_days(F.col("_first"), F.col("_second")).alias("days_to_second_order")
    return per_customer.select(
        "customer_unique_id",
        "first_purchase_timestamp",
        "last_purchase_timestamp",
        "delivered_orders",
        "observed_gmv_brl",
        days,
    )


def cohort_retention(model: Model) -> DataFrame:
    """Sparse table of customers active per first-purchase month and order month."""
    months = (
        delivered_orders(model)
        .filter("customer_unique_id IS NOT NULL")
        .select("customer_unique_id", F.col("purchase_month").alias("order_month"))
        .distinct()
    )
    # A customer has at most one row per calendar month here, so no group is large.
    own = Window.partitionBy("customer_unique_id")
    period = month_index(F.col("order_month")) - month_index(F.col("cohort_month"))
    active = (
        months.withColumn("cohort_month", F.min("order_month").over(own))
        .groupBy("cohort_month", "order_month")
        .agg(F.count("*").alias("active_customers"))
        .withColumn("cohort_period", period)
    )
    # Every customer is active in the cohort month itself.
    started = F.max(F.when(F.col("cohort_period") == 0, F.col("active_customers")))
    size = started.over(Window.partitionBy("cohort_month"))
    return active.withColumn("cohort_customers", size).select(
        "cohort_month",
        "order_month",
        "cohort_period",
        "active_customers",
        "cohort_customers",
        ratio(F.col("active_customers"), F.col("cohort_customers")).alias("retention_rate"),
    )


def waiting_times(model: Model) -> DataFrame:
    """Per customer with a delivered order: how long they have been followed since the
    first one, and how long the second one took, in microseconds. Either may be null."""
    orders = delivered_orders(model)
    number, purchased = F.col("customer_delivered_order_number"), F.col("order_purchase_timestamp")
    customers = (
        orders.filter(number <= 2)
        .groupBy("customer_unique_id")
        .agg(
            F.min(F.when(number == 1, purchased)).alias("first"),
            F.min(F.when(number == 2, purchased)).alias("second"),
        )
    )
    end = orders.agg(F.max(purchased)).scalar()
    return customers.select(
        elapsed_micros(F.col("first"), end).alias("followed"),
        elapsed_micros(F.col("first"), F.col("second")).alias("waited"),
    )


def repeat_windows(model: Model, windows: Sequence[int] = REPEAT_WINDOWS) -> DataFrame:
    """Second purchase within N days among customers with N days of follow-up.

    All windows are counted in one pass over the customers.
    """
    counted = waiting_times(model)
    counts = [F.count("*").alias("customers")]
    for days in windows:
        eligible = F.col("followed") >= days * MICROS_PER_DAY
        counts.append(F.count_if(eligible).alias(f"eligible_{days}"))
        repeated = eligible & (F.col("waited") <= days * MICROS_PER_DAY)
        counts.append(F.count_if(repeated).alias(f"repeat_{days}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(days).alias("window_days"),
                F.col(f"eligible_{days}").alias("eligible_customers"),
                F.col(f"repeat_{days}").alias("repeat_customers"),
            )
            for days in windows
        ]
    )
    return (
        counted.agg(*counts)
        .filter("customers > 0")
        .select(F.inline(rows))
        .withColumn(
            "repeat_purchase_rate", ratio(F.col("repeat_customers"), F.col("eligible_customers"))
        )
    )


def category_performance(model: Model) -> DataFrame:
    """Order-level rates count an order once per category, not once per item."""
    per_order = (
        delivered_sales(model)
        .groupBy("order_id", F.col("product_category_name_english").alias("category"))
        .agg(
            F.sum("price").alias("gmv"),
            F.sum("freight_value").alias("freight"),
            F.count("*").alias("items"),
            F.max("on_time_flag").alias("on_time_flag"),
            F.max("review_score").alias("review_score"),
        )
    )
    gmv, orders = F.col("delivered_gmv_brl"), F.col("delivered_orders")
    totals = per_order.groupBy("category").agg(
        F.count("*").alias("delivered_orders"),
        F.sum("items").alias("delivered_items"),
        F.sum("gmv").alias("delivered_gmv_brl"),
        F.sum("freight").alias("freight_brl"),
        F.avg("on_time_flag").alias("on_time_delivery_rate"),
        F.avg("review_score").alias("average_review_score"),
    )
    return totals.select(
        "category",
        "delivered_orders",
        "delivered_items",
        "delivered_gmv_brl",
        "freight_brl",
        ratio(gmv, orders).alias("average_order_value_brl"),
        ratio(F.col("freight_brl"), gmv).alias("freight_to_gmv_ratio"),
        "on_time_delivery_rate",
        "average_review_score",
    )


def state_performance(model: Model) -> DataFrame:
    totals = delivered_orders(model).groupBy("customer_state").agg(
        F.count("order_id").alias("delivered_orders"),
        F.count_distinct("customer_unique_id").alias("active_customers"),
        F.sum("item_gmv").alias("delivered_gmv_brl"),
        F.avg("on_time_flag").alias("on_time_delivery_rate"),
        F.avg("review_score").alias("average_review_score"),
        low_review_rate(),
    )
    value = ratio(F.col("delivered_gmv_brl"), F.col("delivered_orders"))
    return totals.select(
        "customer_state",
        "delivered_orders",
        "active_customers",
        "delivered_gmv_brl",
        value.alias("average_order_value_brl"),
        "on_time_delivery_rate",
        "average_review_score",
        "low_review_rate",
    )


def delivery_experience(model: Model) -> DataFrame:
    late = F.when(F.col("late_flag") == 1, "Late").otherwise("On time or early")
    high = F.when(F.col("review_score").isNotNull(), (F.col("review_score") >= HIGH_REVIEW_MIN).cast("int"))
    return (
        delivered_orders(model)
        .filter("late_flag IS NOT NULL")
        .groupBy(late.alias("delivery_group"))
        .agg(
            F.count("order_id").alias("delivered_orders"),
            F.avg("delivery_days").alias("average_delivery_days"),
            F.avg("review_score").alias("average_review_score"),
            low_review_rate(),
            F.avg(high).alias("high_review_rate"),
        )
    )


def payment_mix(model: Model) -> DataFrame:
    """Payments are summed per order and type before the join, which then moves
    few rows per order and makes the distinct order count a row count."""
    per_order = (
        model.stg_order_payments.groupBy("order_id", "payment_type")
        .agg(F.count("*").alias("records"), F.sum("payment_value").alias("value"))
    )
    totals = (
        per_order.join(delivered_orders(model).select("order_id"), "order_id", "left_semi")
        .groupBy("payment_type")
        .agg(
            F.sum("records").alias("payment_records"),
            F.count("*").alias("orders"),
            F.sum("value").alias("payment_value_brl"),
        )
    )
    share = ratio(F.col("payment_value_brl"), total("payment_value_brl"))
    return totals.withColumn("payment_value_share", share)


def rfm_segment_summary(model: Model) -> DataFrame:
    totals = model.mart_customer_rfm.groupBy("segment").agg(
        F.count("*").alias("customers"),
        F.sum("observed_gmv").alias("observed_gmv_brl"),
    )
    customers, gmv = F.col("customers"), F.col("observed_gmv_brl")
    return totals.select(
        "segment",
        "customers",
        "observed_gmv_brl",
        ratio(gmv, customers).alias("average_observed_gmv_brl"),
        ratio(customers, total("customers")).alias("customer_share"),
        ratio(gmv, total("observed_gmv_brl")).alias("observed_gmv_share"),
    )


MARTS = {
    "vw_delivered_orders": delivered_orders,
    "mart_executive_monthly": executive_monthly,
    "mart_customer_lifecycle": customer_lifecycle,
    "mart_cohort_retention": cohort_retention,
    "mart_repeat_windows": repeat_windows,
    "mart_category_performance": category_performance,
    "mart_state_performance": state_performance,
    "mart_delivery_experience": delivery_experience,
    "mart_payment_mix": payment_mix,
    "mart_rfm_segment_summary": rfm_segment_summary,
}


def register_staged(sources: Sources) -> None:
    """Make the nine sources available to SQL users as `stg_<name>`."""
    for name, rows in sources.items():
        rows.createOrReplaceTempView(f"stg_{name}")


def register_views(model: Model) -> None:
    """Make the model tables and marts available to SQL users under these names."""
    for name, rows in model.items():
        rows.createOrReplaceTempView(name)
    for name, mart in MARTS.items():
        mart(model).createOrReplaceTempView(name)
