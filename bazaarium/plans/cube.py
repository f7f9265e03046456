"""A stored cube that answers selections without the facts.

Cells are month, state and segment, and category as well for items. Sums and counts of
cells add up. Distinct customers do not, so each cell also holds who they are: customers
are numbered, 64 numbers make a word, and a row (cell, word) has one bit for each customer
with a delivered order in the cell and one for each with two or more. Over any selection
the words are merged by bitwise operations, exactly: a customer is active if any bit is
set, and a repeat customer if a bit of `twice` is, or bits of `once` in two cells.

Customers are numbered in the order of segment and id, so that the words of a cell are
well filled. The numbers are stored with the cube; a cube is one state of the model and
is built anew, or after a refresh, as a whole.

`totals` and `repeat_rate` answer from the cube where the selection allows it, that is for
whole months, states and segments, and categories for items. Other selections, by day,
product, seller or home, go to the facts.
"""

from __future__ import annotations

from calendar import monthrange
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarium.contracts import Model
from bazaarium.functions.columns import ratio
from bazaarium.plans import measures
from bazaarium.plans.marts import delivered_sales
from bazaarium.plans.measures import Selection
from bazaarium.plans.model import DELIVERED, LOW_REVIEW_MAX

CELL = ("purchase_month", "customer_state", "segment")
CATEGORY = "product_category_name_english"


@dataclass(frozen=True)
class Cube:
    """orders: sums by cell; words: customers by cell; sales: value by cell and category."""

    orders: DataFrame
    words: DataFrame
    sales: DataFrame


def _numbered_customers(model: Model) -> DataFrame:
    """(customer_unique_id, segment, number), to be stored before it is used twice."""
    ordered = model.mart_customer_rfm.select("customer_unique_id", "segment").repartitionByRange("segment", "customer_unique_id")
    return ordered.sortWithinPartitions("segment", "customer_unique_id").withColumn("number", F.monotonically_increasing_id())


def _order_sums(orders: DataFrame) -> DataFrame:
    on_time, score = F.col("on_time_flag"), F.col("review_score")
    return orders.groupBy(*CELL).agg(
        F.count("order_id").alias("orders"),
        F.count("on_time_flag").alias("evaluable"),
        F.count_if(on_time == 1).alias("on_time"),
        F.count("review_score").alias("reviewed"),
        F.count_if(score <= LOW_REVIEW_MAX).alias("low_reviewed"),
        F.sum("review_score").alias("score_sum"),
        F.sum("delivery_days").alias("days_sum"),
        F.count("delivery_days").alias("days_count"),
        F.sum("freight_value").alias("freight"),
        F.sum("item_gmv").alias("gmv"),
    )


def _customer_words(orders: DataFrame) -> DataFrame:
    per_customer = orders.filter("number IS NOT NULL").groupBy(*CELL, "number").agg(F.count("*").alias("n"))
    bit = "shiftleft(1L, CAST(number & 63 AS INT))"
    return per_customer.groupBy(*CELL, F.expr("shiftright(number, 6)").alias("word")).agg(
        F.expr(f"bit_or({bit})").alias("once"), F.expr(f"bit_or(CASE WHEN n >= 2 THEN {bit} ELSE 0L END)").alias("twice")
    )


def build(model: Model, root: str) -> None:
    """Derive the cube of a stored model and store it under `root`."""
    spark = model.fact_orders.sparkSession
    root = root.rstrip("/")
    _numbered_customers(model).write.mode("overwrite").parquet(f"{root}/customers")
    customers = spark.read.parquet(f"{root}/customers")
    # Either side is shuffled straight from a stored table, so AQE splits a hot customer.
    orders = model.fact_orders.filter(F.col("order_status") == DELIVERED).join(customers, "customer_unique_id", "left")
    _order_sums(orders).write.mode("overwrite").parquet(f"{root}/orders")
    _customer_words(orders).write.mode("overwrite").parquet(f"{root}/words")
    sold = delivered_sales(model).join(customers.drop("number"), "customer_unique_id", "left")
    sales = sold.groupBy(*CELL, CATEGORY).agg(F.sum("price").alias("price"))
    sales.write.mode("overwrite").parquet(f"{root}/sales")


def read(spark: SparkSession, root: str) -> Cube:
    return Cube(**{name: spark.read.parquet(f"{root.rstrip('/')}/{name}") for name in ("orders", "words", "sales")})


def answers(selection: Selection) -> bool:
    """Whether the cube's columns decide the selection."""
    by_fact = (selection.products, selection.sellers, selection.home_states, selection.home_cities)
    if any(values is not None for values in by_fact):
        return False
    if selection.period is None:
        return True
    first, last = selection.period
    return first.day == 1 and last.day == monthrange(last.year, last.month)[1]


def _selected(rows: DataFrame, selection: Selection) -> DataFrame:
    if selection.period is not None:
        first, last = selection.period
        rows = rows.filter(F.col("purchase_month").between(f"{first:%Y-%m}", f"{last:%Y-%m}"))
    for name, values in (("customer_state", selection.states), ("segment", selection.segments)):
        if values is not None:
            rows = rows.filter(F.col(name).isin(list(values)))
    return rows


def _merged(words: DataFrame, *by: str) -> DataFrame:
    """(by, word, once, twice): who has an order in any cell, and who has two in all."""
    cells = F.collect_list(F.struct("once", "twice"))
    none = F.struct(F.lit(0).cast("bigint").alias("once"), F.lit(0).cast("bigint").alias("twice"))

    def add(total, cell):
        again = total["once"].bitwiseAND(cell["once"])
        return F.struct(
            total["once"].bitwiseOR(cell["once"]).alias("once"),
            total["twice"].bitwiseOR(cell["twice"]).bitwiseOR(again).alias("twice"),
        )

    merged = words.groupBy(*by, "word").agg(F.aggregate(cells, none, add).alias("both"))
    return merged.select(*by, "word", "both.once", "both.twice")


def totals(cube: Cube, model: Model, selection: Selection = Selection()) -> DataFrame:
    """`measures.totals`, from the cube if it can answer."""
    if not answers(selection):
        return measures.totals(model, selection)
    sales = _selected(cube.sales, selection)
    if selection.categories is not None:
        sales = sales.filter(F.col(CATEGORY).isin(list(selection.categories)))
    once = _selected(cube.words, selection).groupBy("word").agg(F.bit_or("once").alias("once"))
    active = once.agg(F.coalesce(F.sum(F.bit_count("once")), F.lit(0)).cast("bigint")).scalar()

    def total(name: str):
        return F.coalesce(F.sum(name), F.lit(0))

    cards = _selected(cube.orders, selection).agg(
        total("orders").alias("delivered_orders"),
        total("evaluable").alias("delivery_evaluable_orders"),
        total("on_time").alias("on_time_delivered_orders"),
        ratio(F.sum("on_time"), F.sum("evaluable")).alias("on_time_delivery_rate"),
        total("reviewed").alias("reviewed_delivered_orders"),
        total("low_reviewed").alias("low_review_delivered_orders"),
        ratio(F.sum("low_reviewed"), F.sum("reviewed")).alias("low_review_rate"),
        ratio(F.sum("freight"), F.sum("gmv")).alias("freight_to_gmv_ratio"),
        ratio(F.sum("days_sum"), F.sum("days_count")).alias("average_delivery_days"),
        ratio(F.sum("score_sum"), F.sum("reviewed")).alias("average_review_score"),
    )
    gmv = sales.agg(F.sum("price")).scalar()
    aov = ratio(F.col("delivered_gmv"), F.col("delivered_orders"))
    return cards.withColumn("active_customers", active).withColumn("delivered_gmv", gmv).withColumn("delivered_aov", aov)


def repeat_rate(cube: Cube, model: Model, selection: Selection = Selection(), by: tuple[str, ...] = ()) -> DataFrame:
    """`measures.repeat_rate`, from the cube if it can answer; by: any columns of a cell."""
    if not answers(selection) or not set(by) <= set(CELL):
        return measures.repeat_rate(model, selection, by)
    counted = _merged(_selected(cube.words, selection), *by).groupBy(*by).agg(
        F.coalesce(F.sum(F.bit_count("once")), F.lit(0)).cast("bigint").alias("active_customers"),
        F.coalesce(F.sum(F.bit_count("twice")), F.lit(0)).cast("bigint").alias("repeat_customers"),
    )
    rate = ratio(F.col("repeat_customers"), F.col("active_customers"))
    return counted.withColumn("repeat_customer_rate", rate)
