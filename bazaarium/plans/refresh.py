"""Incremental rebuild of a stored model from a delivery of new or changed orders.

A delivery holds whole orders: for each order id in it, its rows of orders, customers,
items, payments and reviews replace all that was known of that order. Products, sellers
and category names come as whole tables. What changes is found, not rebuilt:

- the delivered orders are derived from the delivery alone, as a full build derives them;
- the customers of these orders, before and after, are touched: an order that is
  inserted, gone late or cancelled renumbers their other delivered orders;
- a scan of three columns names the months of these rows, and only those months are read;
- a month of orders is replaced where a row differs from what is stored, a month of
  items where a delivered order had or has items. All other months keep their files.

The months to be replaced are first written beside the model and then swapped in, month
by month. A refresh that was cut off is repeated with the same delivery: what is already
in place no longer differs. Payments carry no month and are rewritten; dimensions and the
customer segments, which depend on all customers, are made anew from the stored facts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarium.contracts import MODEL, Model, Sources, columns
from bazaarium.functions.columns import sure_flag
from bazaarium.operators.skew import SkewPolicy
from bazaarium.plans import model as plans
from bazaarium.sinks import tables

MONTH = "purchase_month"
_NUMBER, _FIRST = "customer_delivered_order_number", "first_observed_delivered_order_flag"


def _in_months(months: Sequence[str | None]) -> Column:
    known = F.col(MONTH).isin([m for m in months if m is not None])
    return known | F.col(MONTH).isNull() if None in months else F.coalesce(known, F.lit(False))


def _months(*frames: DataFrame) -> list[str | None]:
    """The distinct months of some rows: a list that grows with the calendar, not with the rows."""
    every = reduce(DataFrame.union, [f.select(MONTH).distinct() for f in frames]).distinct()
    return [row[MONTH] for row in every.collect()]


def _order_ids(delivery: Sources) -> DataFrame:
    return delivery.orders.select("order_id").filter("order_id IS NOT NULL").distinct()


def _renumbered(orders: DataFrame, policy: SkewPolicy) -> DataFrame:
    """Whole histories of some customers with their delivered orders numbered anew."""
    bare = orders.drop(_NUMBER, _FIRST)
    numbered = plans.number_delivered_orders(bare, bare.select("customer_unique_id"), policy)
    return numbered.withColumn(_FIRST, sure_flag(F.col(_NUMBER) == 1)).select(*orders.columns)


def renewed_orders(orders: DataFrame, fresh: DataFrame, policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """All orders of the touched customers as they are after the delivery, and the delivered ones.

    orders: the stored fact; fresh: the delivered orders, with any numbers.
    """
    ids = fresh.select("order_id")
    places = orders.select("order_id", "customer_unique_id", MONTH)
    replaced = places.join(ids, "order_id", "left_semi")
    owners = replaced.select("customer_unique_id").union(fresh.select("customer_unique_id"))
    touched = owners.filter("customer_unique_id IS NOT NULL").distinct()
    months = _months(places.join(touched, "customer_unique_id", "left_semi"))
    others = orders.filter(_in_months(months)).join(ids, "order_id", "left_anti").join(touched, "customer_unique_id", "left_semi")
    return _renumbered(others.select(*fresh.columns).unionByName(fresh), policy)


def changed_months(orders: DataFrame, renewed: DataFrame) -> list[str | None]:
    """Months that lose, get or change a row when the renewed orders take the place of the stored ones."""
    names = renewed.columns
    ids = renewed.select("order_id")
    months = _months(orders.join(ids, "order_id", "left_semi"))
    old = orders.filter(_in_months(months)).join(ids, "order_id", "left_semi")
    old = old.select("order_id", F.struct(*names).alias("old"))
    new = renewed.select("order_id", F.struct(*names).alias("new"))
    differ = old.join(new, "order_id", "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    sides = [differ.filter(F.col(side).isNotNull()).select(F.col(side)[MONTH].alias(MONTH)) for side in ("old", "new")]
    return _months(*sides)


def replaced_rows(stored: DataFrame, renewed: DataFrame, months: Sequence[str | None]) -> DataFrame:
    """All rows of the given months after the renewed orders took the place of the stored ones."""
    ids = renewed.select("order_id").distinct()
    kept = stored.filter(_in_months(months)).join(ids, "order_id", "left_anti")
    return kept.select(*renewed.columns).unionByName(renewed.filter(_in_months(months)))


def refresh(
    spark: SparkSession,
    root: str,
    delivery: Sources,
    scratch: str,
    policy: SkewPolicy = SkewPolicy(),
    item_spread: Sequence[str] = ("order_item_id",),
) -> dict[str, list[str | None]]:
    """Bring the model stored under `root` up to date; return the months that were replaced.

    `scratch` is an empty folder on the same store for what is written on the way.
    """

    def kept(rows: DataFrame, name: str) -> DataFrame:
        path = f"{scratch.rstrip('/')}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    model = tables.read_model(spark, root)
    ids = kept(_order_ids(delivery), "order_ids")
    fresh = kept(plans.fact_orders(delivery, policy).filter("order_id IS NOT NULL"), "delivered_orders")
    fresh_sales = plans.fact_sales(delivery, fresh, policy, item_spread, lambda rows: kept(rows, "delivered_sales"))
    renewed = kept(renewed_orders(model.fact_orders, fresh, policy), "renewed_orders")

    # Items first: a delivered order's former month is still to be read from the orders.
    before = model.fact_orders.select("order_id", MONTH).join(ids, "order_id", "left_semi")
    of_sales = _months(before, fresh_sales)
    known = model.fact_sales.filter(_in_months(of_sales)).join(ids, "order_id", "left_anti")
    sales = known.select(*fresh_sales.columns).unionByName(fresh_sales.filter(_in_months(of_sales)))
    of_orders = changed_months(model.fact_orders, renewed)
    orders = kept(replaced_rows(model.fact_orders, renewed, of_orders), "orders")
    tables.replace_months(kept(sales, "sales"), root, "fact_sales", of_sales)
    tables.replace_months(orders, root, "fact_orders", of_orders)

    paid = model.stg_order_payments
    payments = paid.join(ids, "order_id", "left_anti").unionByName(delivery.order_payments.select(*paid.columns))
    tables.write_table(kept(payments, "payments"), root, "stg_order_payments")
    after = tables.read_model(spark, root).fact_orders
    for name, rows in {
        "dim_customer": plans.dim_customer(after),
        "dim_product": plans.dim_product(delivery.products, delivery.category_translation),
        "dim_seller": plans.dim_seller(delivery.sellers),
        "dim_date": plans.dim_date(after),
        "mart_customer_rfm": plans.mart_customer_rfm(after),
    }.items():
        tables.write_table(rows.select(*columns(MODEL[name])), root, name)
    return {"fact_orders": of_orders, "fact_sales": of_sales}


def restricted(sources: Sources, orders: DataFrame) -> Sources:
    """The sources with these orders alone, and what belongs to them."""
    ids, people = orders.select("order_id").distinct(), orders.select("customer_id").distinct()
    of_orders = {n: getattr(sources, n).join(ids, "order_id", "left_semi") for n in ("order_items", "order_payments", "order_reviews")}
    customers = sources.customers.join(people, "customer_id", "left_semi")
    return Sources(**dict(sources.items()) | of_orders | {"orders": orders, "customers": customers})
