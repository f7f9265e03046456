"""Order-bucketed storage: the facts' per-order joins without a shuffle.

`store` writes what the facts are made of in buckets of `order_id`, all tables with the
same number of buckets: orders with their customer and their place in the customer's
history, items with their category, payments and reviews. Each is shuffled by order once,
when it is stored. From then on every aggregate and join by order reads matching buckets
in one task, and neither fact plans an Exchange on `order_id`.

A bucket is one task, so it must not hold an order with very many rows. Rows of hot
orders, and rows without an order id, are stored beside the buckets in a plain table that
any number of tasks can read. They are aggregated on the map side and set beside the
orders; an order's rows are either all in its bucket or all in the plain table.

The layout (number of buckets, schemas) lies beside the data, so another session can
declare the same tables over the same files.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bazaarium.contracts import MODEL, Sources, columns
from bazaarium.operators.skew import HotKeys, SkewPolicy, hot_keys, mark_hot, salted_join
from bazaarium.plans import model as plans
from bazaarium.session import PARTITIONS, TASK_BYTES, scanned_bytes, set_for
from bazaarium.sources import files

KEY = "order_id"
ORDERS = "orders"
#: Tables of many rows for an order.
CHILDREN = ("items", "payments", "reviews")
_LAYOUT = "layout.json"
_IN_BUCKETS = plans.BY_ORDER


@dataclass(frozen=True)
class Child:
    """`bucketed`: rows of ordinary orders. `loose`: rows of hot orders or of none."""

    bucketed: DataFrame
    loose: DataFrame


@dataclass(frozen=True)
class OrderBuckets:
    orders: DataFrame
    items: Child
    payments: Child
    reviews: Child
    #: Orders with loose items; None where there are none.
    hot_items: HotKeys | None


def _table(location: str, buckets: int) -> str:
    """A catalog name that follows from place and layout, so that sessions agree on it."""
    return f"order_buckets_{hashlib.sha256(location.encode()).hexdigest()[:24]}_{buckets}"


def _write(rows: DataFrame, location: str, buckets: int) -> None:
    """One file for each bucket: rows are shuffled by the very hash that names the buckets.

    Rows that lie so already are not shuffled again. Rows of an order stand together, which
    makes smaller files.
    """
    placed = rows.repartition(buckets, KEY)
    written = placed.write.mode("overwrite").format("parquet").options(path=location, compression="zstd")
    written.bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(_table(location, buckets))


def _declared(spark: SparkSession, location: str, schema: StructType, buckets: int) -> DataFrame:
    name = _table(location, buckets)
    if not spark.catalog.tableExists(name):
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE {name} ({names}) USING parquet "
            f"CLUSTERED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
    return spark.table(name)


def _split(rows: DataFrame, hot: HotKeys | None) -> tuple[DataFrame, DataFrame]:
    """Rows for the buckets and loose rows."""
    missing = F.col(KEY).isNull()
    if hot is None:
        return rows.filter(~missing), rows.filter(missing)
    marked = mark_hot(rows, hot)
    loose = missing | F.col("_rows").isNotNull()
    return marked.filter(~loose).select(*rows.columns), marked.filter(loose).select(*rows.columns)


def bucket_count(sources: Sources) -> int:
    """Enough buckets that one of the largest table is a task's worth, and one for each core."""
    largest = max(scanned_bytes(rows) for _, rows in sources.items())
    cores = sources.orders.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-largest // TASK_BYTES))


def store(
    sources: Sources, root: str, buckets: int | None = None, policy: SkewPolicy = SkewPolicy()
) -> OrderBuckets:
    """Write the order-bucketed tables under `root`, an empty or former folder of them."""
    spark, root = sources.orders.sparkSession, root.rstrip("/")
    buckets = bucket_count(sources) if buckets is None else buckets
    products = plans.translated_products(sources.products, sources.category_translation)
    raw = {"items": sources.order_items, "payments": sources.order_payments, "reviews": sources.order_reviews}
    children = raw | {"items": plans.enriched_items(sources.order_items, products)}
    orders = plans.numbered_orders(sources, policy)
    _write(orders, f"{root}/{ORDERS}", buckets)
    schemas = {ORDERS: orders.schema.jsonValue()}
    for name in CHILDREN:
        hot = hot_keys(raw[name], KEY, policy)
        bucketed, _ = _split(raw[name], hot)
        if name == "items":
            bucketed = plans.categorized_by_order(bucketed, products, buckets).select(*children[name].columns)
        with set_for(spark, {PARTITIONS: str(buckets), **_IN_BUCKETS}):
            _write(bucketed, f"{root}/{name}", buckets)
        _, loose = _split(children[name], hot)
        loose.write.mode("overwrite").parquet(f"{root}/{name}_loose")
        schemas[name] = children[name].schema.jsonValue()
    # Written last: a folder with a layout is complete.
    files.write_text(spark, f"{root}/{_LAYOUT}", json.dumps({"buckets": buckets, "schemas": schemas}))
    return read(spark, root, policy)


def read(spark: SparkSession, root: str, policy: SkewPolicy = SkewPolicy()) -> OrderBuckets:
    """The tables stored under `root`, in this session or in an earlier one."""
    root = root.rstrip("/")
    layout = json.loads(spark.read.text(f"{root}/{_LAYOUT}", wholetext=True).first()[0])
    schemas = {name: StructType.fromJson(kept) for name, kept in layout["schemas"].items()}

    def declared(name: str) -> DataFrame:
        return _declared(spark, f"{root}/{name}", schemas[name], layout["buckets"])

    def child(name: str) -> Child:
        return Child(declared(name), spark.read.schema(schemas[name]).parquet(f"{root}/{name}_loose"))

    found = {name: child(name) for name in CHILDREN}
    return OrderBuckets(declared(ORDERS), hot_items=_hot_of(found["items"].loose, policy), **found)


def _hot_of(loose: DataFrame, policy: SkewPolicy) -> HotKeys | None:
    """The hot orders, from the loose rows alone."""
    counted = loose.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count("*").alias("_rows"))
    found = counted.limit(policy.local_keys + 1).toArrow()
    if not found.num_rows:
        return None
    if found.num_rows > policy.local_keys:
        return HotKeys(counted, KEY, False, policy)
    return HotKeys(loose.sparkSession.createDataFrame(found, counted.schema), KEY, True, policy)


def _beside(orders: DataFrame, child: Child, per_order: Callable[[DataFrame], DataFrame], any_loose: bool) -> DataFrame:
    """Orders with an aggregate of their rows; where no row is loose, one join of buckets."""
    orders = orders.join(per_order(child.bucketed), KEY, "left")
    if not any_loose:
        return orders
    loose = per_order(child.loose)
    names = [name for name in loose.columns if name != KEY]
    loose = loose.withColumnsRenamed({name: f"_loose_{name}" for name in names})
    merged = {name: F.coalesce(F.col(name), F.col(f"_loose_{name}")) for name in names}
    return orders.join(loose, KEY, "left").withColumns(merged).drop(*[f"_loose_{name}" for name in names])


def _any_of_an_order(child: Child) -> bool:
    return not child.loose.filter(F.col(KEY).isNotNull()).isEmpty()


def fact_orders(stored: OrderBuckets) -> DataFrame:
    """As `model.fact_orders`, from matching buckets.

    Only aggregates of loose rows are shuffled, one row for an order and task.
    """
    steps = (
        ("items", plans.item_totals),
        ("items", plans.item_categories),
        ("payments", plans.payment_order),
        ("reviews", plans.review_order),
    )
    loose = {name: _any_of_an_order(getattr(stored, name)) for name in CHILDREN}
    orders = stored.orders
    for name, per_order in steps:
        orders = _beside(orders, getattr(stored, name), per_order, loose[name])
    return plans.derived_orders(orders)


def fact_sales(stored: OrderBuckets, spread: tuple[str, ...] = ("order_item_id",)) -> DataFrame:
    """As `model.fact_sales`: buckets side by side, and the loose items by a salted join.

    The few orders that have loose items are looked up first, so that only these are
    copied over the salts.
    """
    orders = fact_orders(stored).select(KEY, *plans.SALES_ORDER_COLUMNS)
    named = columns(MODEL["fact_sales"])
    sold = stored.items.bucketed.join(orders, KEY, "left").select(*named)
    loose, hot = stored.items.loose, stored.hot_items
    if hot is None:
        # Only items without an order are left.
        empty = [F.lit(None).cast(orders.schema[c].dataType).alias(c) for c in plans.SALES_ORDER_COLUMNS]
        return sold.unionByName(loose.select("*", *empty).select(*named))
    few = orders.join(hot.hinted().select(KEY), KEY, "left_semi")
    return sold.unionByName(salted_join(loose, few, KEY, spread, hot).select(*named))
