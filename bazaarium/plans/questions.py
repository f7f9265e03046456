"""Five standing business questions over the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarium.contracts import Model
from bazaarium.functions.columns import cents, ratio
from bazaarium.operators.ranking import dense_rank_descending
from bazaarium.plans import quality
from bazaarium.plans.marts import delivered_orders, delivered_sales, low_review_rate, previous_month


def gmv_reconciliation(model: Model) -> DataFrame:
    return quality.gmv_reconciliation(model.fact_orders, model.fact_sales)


def top_categories_by_state(model: Model, places: int = 3) -> DataFrame:
    """Best categories of each state by GMV; ties share a place and are all kept."""
    by_value = Window.partitionBy("customer_state").orderBy(F.col("delivered_gmv_brl").desc())
    return (
        delivered_sales(model)
        .groupBy("customer_state", F.col("product_category_name_english").alias("category"))
        .agg(
            F.count_distinct("order_id").alias("delivered_orders"),
            F.sum("price").alias("delivered_gmv_brl"),
        )
        .withColumn("category_rank", F.dense_rank().over(by_value))
        .filter(F.col("category_rank") <= places)
        .orderBy("customer_state", "category_rank")
    )


def seller_scorecard(model: Model, min_orders: int = 20) -> DataFrame:
    """Sellers with enough delivered orders, ranked among themselves by GMV.

    Delivery and review are those of the order and count once per order and seller.
    """
    per_order = (
        delivered_sales(model)
        .groupBy("order_id", "seller_id")
        .agg(
            F.sum("price").alias("gmv"),
            F.max("on_time_flag").alias("on_time_flag"),
            F.max("review_score").alias("review_score"),
        )
    )
    scored = (
        per_order.groupBy("seller_id")
        .agg(
            F.count("*").alias("delivered_orders"),
            F.sum("gmv").alias("delivered_gmv_brl"),
            F.avg("on_time_flag").alias("on_time_delivery_rate"),
            F.avg("review_score").alias("associated_order_review_score"),
        )
        .filter(F.col("delivered_orders") >= min_orders)
    )
    ranked = dense_rank_descending(scored, cents("delivered_gmv_brl"), "gmv_rank")
    return ranked.orderBy(F.col("delivered_gmv_brl").desc(), "seller_id")


def review_by_delay_band(model: Model) -> DataFrame:
    delay = F.col("delay_days")
    band = (
        F.when(delay <= 0, "On time or early")
        .when(delay <= 3, "1-3 days late")
        .when(delay <= 7, "4-7 days late")
        .otherwise("More than 7 days late")
    )
    return (
        delivered_orders(model)
        .filter("review_score IS NOT NULL AND delay_days IS NOT NULL")
        .groupBy(band.alias("delivery_band"))
        .agg(
            F.count("order_id").alias("reviewed_orders"),
            F.avg("review_score").alias("average_review_score"),
            low_review_rate(),
            F.min(delay).alias("_least_delay"),
        )
        .orderBy("_least_delay")
        .drop("_least_delay")
    )


def monthly_gmv_change(model: Model) -> DataFrame:
    gmv, prior = F.col("delivered_gmv_brl"), F.col("prior_month_gmv_brl")
    return (
        delivered_orders(model)
        .groupBy("purchase_month")
        .agg(
            F.count("order_id").alias("delivered_orders"),
            F.sum("item_gmv").alias("delivered_gmv_brl"),
        )
        .withColumn("prior_month_gmv_brl", previous_month("delivered_gmv_brl"))
        .withColumn("gmv_mom_rate", ratio(gmv - prior, prior))
        .orderBy("purchase_month")
    )
