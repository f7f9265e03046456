"""The star schema: two facts, four dimensions and the customer segmentation mart.

Items, payments and reviews are many per order. Each is aggregated to one row per
order before it is joined, otherwise money would be multiplied. The optimizer knows
that such an aggregate has unique keys, so a plan that needs none of its columns
drops the whole branch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarium.contracts import Model, Sources, columns, MODEL
from bazaarium.functions.columns import (
    cents,
    elapsed_days,
    flag,
    magnitude_bucket,
    month_key,
    ratio,
    sure_flag,
    whole_days,
)
from bazaarium.operators.quantile import exact_quantile
from bazaarium.operators.ranking import number_within
from bazaarium.operators.skew import HotKeys, SkewPolicy, hot_keys, salted_join
from bazaarium.session import set_for

UNKNOWN_CATEGORY = "unknown"
DELIVERED = "delivered"
HIGH_VALUE_QUANTILE = 0.75
LOW_REVIEW_MAX = 2

# What an item row takes from its order.
SALES_ORDER_COLUMNS = (
    "customer_unique_id", "order_status", "purchase_date", "purchase_month",
    "customer_state", "on_time_flag", "late_flag", "review_score", "low_review_flag",
    "primary_payment_type", "max_installments",
)

# Rows of one order lie in one task; a join by order and something else needs no more.
BY_ORDER = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}

# After any time as text: gives rows without a purchase time the last chunk.
_NO_TIME = "9999-12-31 24"
# Leading characters of a text id that make a range of ids.
_ID_RANGE = 3


def translated_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Products with the English category; untranslated ones become `unknown`.

    The translation is grouped by its key, which changes nothing where the key is
    unique but proves it, so a plan that needs no category drops the join.
    """
    category = F.coalesce("product_category_name_english", F.lit(UNKNOWN_CATEGORY))
    name = "product_category_name_english"
    unique = translation.groupBy("product_category_name").agg(F.max(name).alias(name))
    return products.join(unique, "product_category_name", "left").withColumn(name, category)


def enriched_items(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items with their category; a missing product is `unknown` too.

    A best-selling product makes a hot join key, on the side that is shuffled straight
    from its scan, which AQE splits by itself. Products are grouped by their key for the
    same reason as the translation.
    """
    name = "product_category_name_english"
    unique = products.groupBy("product_id").agg(F.max(name).alias(name))
    return items.join(unique, "product_id", "left").withColumn(
        name, F.coalesce(name, F.lit(UNKNOWN_CATEGORY))
    )


def categorized_by_order(items: DataFrame, products: DataFrame, *buckets: int) -> DataFrame:
    """As `enriched_items`, for items that have an order, spread by order.

    Only the ids of order and product go to the products and come back with a category; the
    items themselves are moved by order alone. The join is by order and product, but
    where `BY_ORDER` is set both sides may be spread by order.
    """
    name = "product_category_name_english"
    found = enriched_items(items.select("order_id", "product_id"), products).repartition(*buckets, "order_id")
    unique = found.groupBy("order_id", "product_id").agg(F.max(name).alias(name))
    joined = items.join(unique, ["order_id", "product_id"], "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(UNKNOWN_CATEGORY)))


def item_totals(items: DataFrame) -> DataFrame:
    """Items to order grain: money, item count and distinct sellers."""
    return (
        items.filter("order_id IS NOT NULL")
        .groupBy("order_id")
        .agg(
            F.coalesce(F.sum("price"), F.lit(0)).cast("decimal(28,2)").alias("item_gmv"),
            F.coalesce(F.sum("freight_value"), F.lit(0)).cast("decimal(28,2)").alias("freight_value"),
            F.count("order_item_id").alias("item_count"),
            F.count_distinct("seller_id").alias("seller_count"),
        )
    )


def item_categories(items_with_category: DataFrame) -> DataFrame:
    """Distinct categories per order.

    Kept apart from `item_totals`: two distinct counts in one aggregate would
    triple its rows, and most plans need no category and so no product join.
    """
    return (
        items_with_category.filter("order_id IS NOT NULL")
        .groupBy("order_id")
        .agg(F.count_distinct("product_category_name_english").alias("category_count"))
    )


def item_order(items: DataFrame, products: DataFrame) -> DataFrame:
    return item_totals(items).join(item_categories(enriched_items(items, products)), "order_id")


def payment_order(payments: DataFrame) -> DataFrame:
    """Payments to order grain, with the type that carries the largest value.

    Payments are first summed per order and type. Equal values go to the type that
    comes first in the alphabet; a missing type counts in the sum only.
    """
    per_type = (
        payments.filter("order_id IS NOT NULL")
        .groupBy("order_id", "payment_type")
        .agg(
            F.coalesce(F.sum("payment_value"), F.lit(0)).cast("decimal(28,2)").alias("value"),
            F.max("payment_installments").alias("installments"),
        )
    )
    typed = F.col("payment_type").isNotNull()
    largest_first = F.when(typed, F.struct(-F.col("value"), F.col("payment_type")))
    return per_type.groupBy("order_id").agg(
        F.sum("value").cast("decimal(28,2)").alias("amount_paid"),
        F.max("installments").alias("max_installments"),
        F.count("payment_type").alias("payment_method_count"),
        F.min_by("payment_type", largest_first).alias("primary_payment_type"),
    )


def review_order(reviews: DataFrame) -> DataFrame:
    return (
        reviews.filter("order_id IS NOT NULL")
        .groupBy("order_id")
        .agg(F.avg("review_score").alias("review_score"), F.count("review_id").alias("review_count"))
    )


def number_delivered_orders(
    orders_with_customer: DataFrame, customers: DataFrame, policy: SkewPolicy
) -> DataFrame:
    """Sequence of a customer's delivered orders by purchase time, then order.

    `customers` holds one record per order, so it shows which persons are hot
    without repeating the join. A hot person is numbered hour by hour; an hour that is
    still too large moment by moment; and a moment, or all orders without a time, by
    ranges of the order id.
    """
    purchased = F.col("order_purchase_timestamp")
    moment = F.coalesce(purchased.cast("string"), F.lit(_NO_TIME))
    text_id = isinstance(orders_with_customer.schema["order_id"].dataType, T.StringType)
    id_range = F.substring("order_id", 1, _ID_RANGE) if text_id else magnitude_bucket("order_id")
    numbered = number_within(
        orders_with_customer,
        keys=["customer_unique_id", "is_delivered"],
        order=[purchased.asc_nulls_last(), F.col("order_id").asc()],
        chunks=[F.substring(moment, 1, 13), moment, id_range],
        hot=hot_keys(customers, "customer_unique_id", policy),
        out="_number",
    )
    number = F.expr("CASE WHEN is_delivered = 1 AND customer_unique_id IS NOT NULL THEN _number END")
    return numbered.withColumn("customer_delivered_order_number", number).drop("_number")


def numbered_orders(sources: Sources, policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Orders with their customer and their place among the customer's delivered orders."""
    base = sources.orders.join(sources.customers, "customer_id", "left").withColumn(
        "is_delivered", sure_flag(F.col("order_status") == DELIVERED)
    )
    return number_delivered_orders(base, sources.customers, policy)


def derived_orders(orders: DataFrame) -> DataFrame:
    """Dates, flags and ratios of orders that have their items, payments and reviews beside them."""
    purchased, arrived, promised = (
        F.col("order_purchase_timestamp"),
        F.col("order_delivered_customer_date"),
        F.col("order_estimated_delivery_date"),
    )
    derived = {
        "purchase_date": F.to_date(purchased),
        "purchase_month": month_key(purchased),
        "delivery_days": elapsed_days(purchased, arrived),
        "delay_days": elapsed_days(promised, arrived),
        "late_flag": flag(arrived > promised),
        "on_time_flag": flag(arrived <= promised),
        "low_review_flag": flag(F.col("review_score") <= LOW_REVIEW_MAX),
        "freight_to_item_value": F.when(
            F.col("item_gmv") > 0, ratio(F.col("freight_value"), F.col("item_gmv"))
        ),
        "first_observed_delivered_order_flag": sure_flag(
            F.col("customer_delivered_order_number") == 1
        ),
    }
    return orders.withColumns(derived).select(*columns(MODEL["fact_orders"]))


def by_order(rows: DataFrame, hot: HotKeys | None) -> DataFrame:
    """Rows that have an order, those of one order in one task unless an order has too many.

    Aggregates by order, and by order and something else, then need no further shuffle.
    With a hot order they combine on the map side instead and shuffle twice.
    """
    present = rows.filter("order_id IS NOT NULL")
    return present if hot else present.repartition("order_id")


def fact_orders(sources: Sources, policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """One row per order, whatever its status."""
    products = translated_products(sources.products, sources.category_translation)
    orders = numbered_orders(sources, policy)
    items, payments = sources.order_items, sources.order_payments
    hot = hot_keys(items, "order_id", policy)
    categories = enriched_items(items, products).select("order_id", "product_category_name_english")
    for per_order in (
        item_totals(by_order(items, hot)),
        item_categories(by_order(categories, hot)),
        payment_order(by_order(payments, hot_keys(payments, "order_id", policy))),
        review_order(sources.order_reviews),
    ):
        orders = orders.join(per_order, "order_id", "left")
    return derived_orders(orders)


def fact_sales(
    sources: Sources,
    orders: DataFrame,
    policy: SkewPolicy = SkewPolicy(),
    spread: Sequence[str] = ("order_item_id",),
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per order item with the attributes of its order.

    An order with very many items is a hot key that AQE cannot split, because the
    order side is itself a join result. It is salted over the `spread` columns.

    `keep` may store the rows and return them as read back. They are then moved by order
    alone where no order is hot. A plan that is run elsewhere moves them by product first,
    as the session's settings then decide how its joins are spread.
    """
    products = translated_products(sources.products, sources.category_translation)
    items, named = sources.order_items, columns(MODEL["fact_sales"])
    attributes = orders.select("order_id", *SALES_ORDER_COLUMNS)
    hot = hot_keys(items, "order_id", policy)
    if keep is None or hot is not None:
        sold = salted_join(enriched_items(items, products), attributes, key="order_id", spread=spread, hot=hot).select(*named)
        return sold if keep is None else keep(sold)
    bought = categorized_by_order(items.filter("order_id IS NOT NULL"), products)
    sold = bought.join(attributes, "order_id", "left").select(*named)
    nothing = [F.lit(None).cast(attributes.schema[c].dataType).alias(c) for c in SALES_ORDER_COLUMNS]
    loose = enriched_items(items.filter("order_id IS NULL"), products).select("*", *nothing)
    with set_for(orders.sparkSession, BY_ORDER):
        return keep(sold.unionByName(loose.select(*named)))


def dim_customer(orders: DataFrame) -> DataFrame:
    """Location on a customer's latest order of any status.

    Equal purchase times are decided by the order id; an order without a purchase
    time is never the latest.
    """
    latest = F.max(
        F.struct("order_purchase_timestamp", "order_id", "customer_city", "customer_state")
    ).alias("latest")
    return (
        orders.groupBy("customer_unique_id")
        .agg(latest)
        .select("customer_unique_id", "latest.customer_city", "latest.customer_state")
    )


def dim_product(products: DataFrame, translation: DataFrame) -> DataFrame:
    return translated_products(products, translation).select(*columns(MODEL["dim_product"]))


def dim_seller(sellers: DataFrame) -> DataFrame:
    return sellers


def dim_date(orders: DataFrame) -> DataFrame:
    """Every calendar day from the first to the last purchase of any status."""
    span = orders.agg(
        F.to_date(F.min("order_purchase_timestamp")).alias("first"),
        F.to_date(F.max("order_purchase_timestamp")).alias("last"),
    )
    days = span.select(F.explode(F.expr("sequence(first, last, interval 1 day)")).alias("date"))
    date = F.col("date")
    return days.select(
        "date",
        F.date_format(date, "yyyyMMdd").cast("int").alias("date_key"),
        F.year(date).alias("year"),
        F.concat(F.lit("Q"), F.quarter(date)).alias("quarter"),
        F.month(date).alias("month_number"),
        F.date_format(date, "MMM").alias("month_name"),
        month_key(date).alias("year_month"),
        F.weekofyear(date).alias("week_of_year"),
        F.date_format(date, "EEE").alias("day_of_week"),
    )


def _segment(frequency: Column, recency: Column, high_value: Column) -> Column:
    """Fixed rules; the first that holds decides."""
    once = frequency == 1
    return (
        F.when((frequency >= 2) & (recency <= 180), "Active repeat")
        .when((frequency >= 2) & (recency > 180), "Lapsed repeat")
        .when(once & (recency <= 90) & high_value, "Recent high-value")
        .when(once & (recency <= 90), "Recent first-time")
        .when(once & (recency > 180) & high_value, "At-risk high-value")
        .when(once & (recency > 180), "Lapsed one-time")
        .otherwise("Mid-cycle one-time")
    )


def _customer_value(orders: DataFrame) -> DataFrame:
    """Per customer with a delivered order; orders without items are worth 0 here."""
    return (
        orders.filter((F.col("order_status") == DELIVERED) & F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(
            F.min("order_purchase_timestamp").alias("first_purchase"),
            F.max("order_purchase_timestamp").alias("last_purchase"),
            F.count("order_id").alias("frequency"),
            F.coalesce(F.sum("item_gmv"), F.lit(0)).cast("decimal(28,2)").alias("observed_gmv"),
        )
    )


def _threshold(customers: DataFrame, q: float) -> DataFrame:
    """One row: the threshold and the last purchase of all customers."""
    value = exact_quantile(customers, cents("observed_gmv"), q, "value_cents", latest="last_purchase")
    return value.select((F.col("value_cents") / 100).alias("high_value_threshold_brl"), F.col("last_purchase").alias("last"))


def high_value_threshold(orders: DataFrame, q: float = HIGH_VALUE_QUANTILE) -> DataFrame:
    """One row: the exact quantile of customer value, as a double."""
    return _threshold(_customer_value(orders), q).select("high_value_threshold_brl")


def mart_customer_rfm(orders: DataFrame) -> DataFrame:
    """Recency, frequency, value and rule-based segment per customer.

    Everything comes from one frame of customers: the last purchase of all and the
    threshold are one row made from it, which is then set beside every customer.
    """
    customers = _customer_value(orders)
    overall = _threshold(customers, HIGH_VALUE_QUANTILE)
    both = overall.select(F.struct("last", "high_value_threshold_brl")).scalar()
    as_of = both["last"] + F.expr("INTERVAL 1 DAY")
    scored = customers.withColumns(
        {
            "recency_days": whole_days(F.col("last_purchase"), as_of),
            "high_value_threshold_brl": both["high_value_threshold_brl"],
        }
    )
    high_value = F.col("observed_gmv").cast("double") >= F.col("high_value_threshold_brl")
    segment = _segment(F.col("frequency"), F.col("recency_days"), high_value)
    return scored.withColumn("segment", segment).select(*columns(MODEL["mart_customer_rfm"]))


def build_model(
    sources: Sources,
    policy: SkewPolicy = SkewPolicy(),
    item_spread: Sequence[str] = ("order_item_id",),
    keep: Callable[[DataFrame, str], DataFrame] | None = None,
) -> Model:
    """The whole model as lazy plans.

    A table is planned when it is first used; planning a fact counts its hot keys. `keep`
    may store a fact, given with its name, and return it as read back, so that the tables
    made from it do not derive it again.
    """

    def kept_orders() -> DataFrame:
        rows = fact_orders(sources, policy)
        return rows if keep is None else keep(rows, "fact_orders")

    def kept_sales() -> DataFrame:
        kept = None if keep is None else lambda rows: keep(rows, "fact_sales")
        return fact_sales(sources, model.fact_orders, policy, item_spread, kept)

    model = Model(
        fact_orders=kept_orders,
        fact_sales=kept_sales,
        dim_customer=lambda: dim_customer(model.fact_orders),
        dim_product=lambda: dim_product(sources.products, sources.category_translation),
        dim_seller=lambda: dim_seller(sources.sellers),
        dim_date=lambda: dim_date(model.fact_orders),
        mart_customer_rfm=lambda: mart_customer_rfm(model.fact_orders),
        stg_order_payments=lambda: sources.order_payments,
    )
    return model
