"""Quality checks as small frames, and the gates that stop a build.

A check frame has one row per check: `(check_name, value, required_zero)`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarium.contracts import Sources
from bazaarium.functions.columns import ratio
from bazaarium.operators.keys import reference_checks, surplus_rows
from bazaarium.plans.model import DELIVERED, UNKNOWN_CATEGORY, high_value_threshold

GMV_TOLERANCE = 0.01


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _as_checks(wide: DataFrame, required_zero: bool) -> DataFrame:
    """Turn a one-row frame of named values into one row per check."""
    doubled = wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns])
    return doubled.unpivot([], doubled.columns, "check_name", "value").withColumn(
        "required_zero", F.lit(required_zero)
    )


def as_checks(frames: Sequence[DataFrame], required_zero: bool = True) -> DataFrame:
    """One-row frames of named values as one check frame."""
    return _union([_as_checks(one, required_zero) for one in frames])


def source_row_counts(sources: Sources) -> DataFrame:
    return _union(
        [
            rows.agg(F.lit(name).alias("source"), F.count("*").alias("row_count"))
            for name, rows in sources.items()
        ]
    )


def raw_checks(sources: Sources) -> DataFrame:
    """Ten checks that must all be zero before anything is built.

    Three aggregates hold the nine that concern items: by order, by product and by seller.
    The signs of amounts are counted with the sellers, which have the fewest keys.
    """
    items = sources.order_items
    # Rows are counted per item key, then per order; only these counts meet the orders.
    per_item = items.groupBy("order_id", "order_item_id").agg(F.count("*").alias("n"))
    per_order = per_item.groupBy("order_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("surplus"))
    signs = {
        "negative_item_prices": F.coalesce(F.col("price") < 0, F.lit(False)),
        "negative_freight_values": F.coalesce(F.col("freight_value") < 0, F.lit(False)),
    }
    counted = [
        surplus_rows(sources.customers, ["customer_id"], "duplicate_customer_ids"),
        reference_checks(
            sources.orders, per_order, "order_id", "duplicate_order_ids", "orphan_item_orders", F.col("n"),
            {"duplicate_order_item_keys": F.col("surplus")},
        ),
        reference_checks(sources.products, items, "product_id", "duplicate_product_ids", "orphan_item_products", F.lit(1)),
        reference_checks(
            sources.sellers, items, "seller_id", "duplicate_seller_ids", "orphan_item_sellers", F.lit(1),
            {name: sign.cast("int") for name, sign in signs.items()},
        ),
    ]
    return _union([_as_checks(one, required_zero=True) for one in counted])


def gate_report(checks: DataFrame) -> DataFrame:
    """A check frame with a verdict for each check."""
    return checks.withColumn("failed", F.col("required_zero") & (F.col("value") != 0))


def gate(checks: DataFrame) -> dict[str, float]:
    """Collect a check frame; raise if a required-zero check is not zero."""
    rows = gate_report(checks).collect()
    failures = {row["check_name"]: int(row["value"]) for row in rows if row["failed"]}
    if failures:
        raise ValueError(f"Raw-data validation failed: {failures}")
    return {row["check_name"]: row["value"] for row in rows}


def require_unique(rows: DataFrame, keys: Sequence[str], name: str) -> None:
    """Cardinality assertion for the one-side of a join."""
    surplus = surplus_rows(rows, keys, "surplus").first()["surplus"]
    if surplus:
        raise ValueError(f"{name} is not unique on {list(keys)}: {surplus} surplus rows")


def join_cardinality(sources: Sources) -> DataFrame:
    """One check row for each one-side of a join: how many of its rows repeat a key."""
    sides = {
        "customers": "customer_id",
        "orders": "order_id",
        "products": "product_id",
        "sellers": "seller_id",
        "category_translation": "product_category_name",
    }
    named = [surplus_rows(getattr(sources, name), [key], f"{name}_{key}") for name, key in sides.items()]
    return _union([_as_checks(one, required_zero=True) for one in named])


def require_unique_join_sides(sources: Sources) -> None:
    """The one-sides whose uniqueness no aggregate guarantees and `raw_checks` leaves out.

    Customers, orders, products and sellers are covered by the duplicate checks;
    per-order items, payments and reviews are grouped by their key.
    """
    require_unique(sources.category_translation, ["product_category_name"], "category_translation")


def gmv_reconciliation(orders: DataFrame, sales: DataFrame) -> DataFrame:
    """One row: delivered GMV at order grain, at item grain, and the difference.

    A fact without rows is worth zero, so a lost one shows as a difference.
    """
    delivered = F.col("order_status") == DELIVERED
    item_gmv = sales.filter(delivered).agg(F.coalesce(F.sum("price"), F.lit(0)).alias("gmv")).scalar()
    totals = orders.filter(delivered).agg(F.coalesce(F.sum("item_gmv"), F.lit(0)).alias("order_fact_gmv"))
    return totals.withColumn("item_fact_gmv", item_gmv).withColumn(
        "reconciliation_difference", F.col("order_fact_gmv") - F.col("item_fact_gmv")
    )


def require_reconciled(reconciliation: DataFrame) -> None:
    difference = reconciliation.first()["reconciliation_difference"]
    if difference is None or abs(float(difference)) > GMV_TOLERANCE:
        raise ValueError(f"Delivered GMV does not reconcile between facts: {difference}")


def _share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def model_checks(orders: DataFrame, sales: DataFrame, rfm: DataFrame | None = None) -> DataFrame:
    """Descriptive checks of the built facts; none of them fails the build.

    The high-value threshold is taken from a stored `rfm` mart if there is one.
    """
    delivered = F.col("order_status") == DELIVERED
    purchased = F.col("order_purchase_timestamp")
    on_orders = orders.agg(
        F.count("*").alias("fact_order_rows"),
        F.count_if(delivered).alias("delivered_order_rows"),
        ratio(F.count_if(delivered & F.col("review_score").isNotNull()), F.count_if(delivered)).alias(
            "review_coverage_delivered_orders"
        ),
        F.count_if(F.col("order_delivered_customer_date") < purchased).alias(
            "invalid_delivery_before_purchase"
        ),
        F.count_if(purchased.isNull()).alias("missing_purchase_time"),
    )
    on_sales = sales.agg(
        F.count("*").alias("fact_sales_rows"),
        _share(F.col("product_category_name_english") == UNKNOWN_CATEGORY).alias(
            "unknown_category_item_share"
        ),
    )
    name = "high_value_threshold_brl"
    found = high_value_threshold(orders) if rfm is None else rfm.agg(F.max(name).alias(name))
    threshold = found.withColumnRenamed(name, f"rfm_{name}")
    return _union([_as_checks(one, required_zero=False) for one in (on_orders, on_sales, threshold)])


def report(counts: DataFrame, checks: Mapping[str, float], *frames: DataFrame) -> dict[str, object]:
    """The quality report as a plain document (tens of values)."""
    document: dict[str, object] = {
        "raw_row_counts": {row["source"]: row["row_count"] for row in counts.collect()}
    }
    document.update(checks)
    for frame in frames:
        if "check_name" in frame.columns:
            document.update({row["check_name"]: row["value"] for row in frame.collect()})
        else:
            # The report's names for the reconciled sums.
            order_gmv, item_gmv, difference = frame.select(
                "order_fact_gmv", "item_fact_gmv", "reconciliation_difference"
            ).first()
            document["delivered_gmv_from_order_fact"] = order_gmv
            document["delivered_gmv_from_item_fact"] = item_gmv
            document["gmv_reconciliation_difference"] = difference
    return document
