"""Facts from order-bucketed tables: same rows, no shuffle by order, hot orders in many tasks."""

from __future__ import annotations

import random
import re
from datetime import datetime

import pytest
from conftest import Shop, frame, records
from test_refresh import random_order

from bazaarium.operators.skew import SkewPolicy
from bazaarium.plans import model as plans
from bazaarium.plans import order_buckets
from bazaarium.session import PARTITIONS, set_for
from bazaarium.sources import star_schema


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def some_shop(seed: int, orders: int = 40) -> Shop:
    shop, rng = Shop(), random.Random(seed)
    for number in range(orders):
        random_order(shop, rng, f"o{number}")
    shop.item(None, 1, "lamp", "north", 5).item("unknown", 1, "lamp", "north", 7)
    shop.rows["order_payments"].append((None, 1, "boleto", 1, None))
    shop.rows["order_reviews"].append(("r", None, 5, None, None))
    return shop


def with_hot_order(shop: Shop, rows: int) -> Shop:
    for number in range(2, rows + 2):
        shop.item("o1", number, "lamp" if number % 2 else "none", f"s{number % 3}", number)
        shop.rows["order_payments"].append(("o1", number, ("boleto", "voucher")[number % 2], 1, number))
        shop.rows["order_reviews"].append((f"h{number}", "o1", 1 + number % 5, None, None))
    return shop


def same_facts(spark, shop: Shop, root: str, policy: SkewPolicy) -> order_buckets.OrderBuckets:
    sources = shop.sources(spark)
    stored = order_buckets.store(sources, root, buckets=3, policy=policy)
    orders = plans.fact_orders(sources)
    assert records(order_buckets.fact_orders(stored)) == records(orders)
    assert records(order_buckets.fact_sales(stored)) == records(plans.fact_sales(sources, orders))
    return stored


def exchanges_by_order(frame) -> list[str]:
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(order_id#[^\n]*", plan)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_facts_without_a_shuffle_by_order(spark, tmp_path, no_broadcast, seed):
    stored = same_facts(spark, some_shop(seed), str(tmp_path / "b"), SkewPolicy())
    for fact in (order_buckets.fact_orders(stored), order_buckets.fact_sales(stored)):
        assert exchanges_by_order(fact) == []
        assert "Bucketed: true" in fact._jdf.queryExecution().executedPlan().toString()
    sources = some_shop(seed).sources(spark)
    assert exchanges_by_order(plans.fact_orders(sources)) != []


@pytest.mark.parametrize("local_keys", [100, 0])
def test_hot_orders_lie_beside_the_buckets(spark, tmp_path, no_broadcast, local_keys):
    policy = SkewPolicy(rows_per_task=5, local_keys=local_keys)
    stored = same_facts(spark, with_hot_order(some_shop(3), 60), str(tmp_path / "b"), policy)
    for child in (stored.items, stored.payments, stored.reviews):
        assert child.bucketed.filter("order_id = 'o1'").count() == 0
        assert child.loose.filter("order_id = 'o1'").count() >= 60
    # Of the shuffles by order, none moves the stored orders or the bucketed rows.
    plan = order_buckets.fact_orders(stored)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(order_id#[^\n]*\n[^\n]*FileScan parquet spark_catalog", plan)


def test_a_hot_order_is_joined_in_several_tasks(spark, tmp_path, no_broadcast):
    policy = SkewPolicy(rows_per_task=50)
    stored = order_buckets.store(with_hot_order(some_shop(4), 400).sources(spark), str(tmp_path / "b"), 3, policy)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    from pyspark.sql import functions as F

    sold = order_buckets.fact_sales(stored).filter("order_id = 'o1'")
    sizes = [r[1] for r in sold.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) >= 400 and len(sizes) >= 3 and max(sizes) < 350


def test_another_session_reads_what_one_stored(spark, tmp_path):
    shop, root = some_shop(5), str(tmp_path / "b")
    order_buckets.store(shop.sources(spark), root, buckets=2)
    other = spark.newSession()
    for name in (order_buckets.ORDERS, *order_buckets.CHILDREN):
        spark.sql(f"DROP TABLE {order_buckets._table(f'{root}/{name}', 2)}")
    again = order_buckets.read(other, root)
    assert records(order_buckets.fact_orders(again)) == records(plans.fact_orders(shop.sources(spark)))
    order_buckets.store(some_shop(6).sources(spark), root, buckets=4)
    found = order_buckets.read(spark, root)
    assert records(order_buckets.fact_orders(found)) == records(plans.fact_orders(some_shop(6).sources(spark)))


def test_empty_sources(spark, tmp_path):
    stored = order_buckets.store(Shop().sources(spark), str(tmp_path / "b"), buckets=2)
    assert order_buckets.fact_orders(stored).count() == order_buckets.fact_sales(stored).count() == 0


def test_the_number_of_buckets_follows_what_is_read(spark, star_folder):
    """Joins among the sources make the optimizer expect far more rows than there are."""
    from bazaarium.sources.star_schema import read_star_sources

    cores = spark.sparkContext.defaultParallelism
    assert order_buckets.bucket_count(read_star_sources(spark, star_folder)) == cores


def lines(spark, orders: int, extra: list[tuple] = ()):
    """Stored lines of a star schema, three for each order and as many products as orders."""
    plain = [(o, (o * 7 + n) % orders, n % 2, 1, 2.0, 10.0 + n, 0.0, 0.0, "A", "F", None) for o in range(orders) for n in range(3)]
    return frame(spark, [*plain, *extra], star_schema.TABLES["lineitem"])


def shuffles_above(plan: str, step: str) -> list[str]:
    """Shuffles that the rows of a step go through afterwards."""
    found, depth = [], None
    for line in reversed(plan.splitlines()):
        name = line.lstrip(" :+-")
        here = len(line) - len(name)
        if depth is None and name.startswith(step) or depth is not None and here < depth:
            depth = here
            found += [name] if "Exchange" in name else []
    assert depth is not None
    return found


def star_of(spark, folder, orders: int):
    day = datetime(2000, 1, 5)
    rows = {
        "region": [(0, "R")],
        "nation": [(n, f"N{n}", 0) for n in range(25)],
        "customer": [(c, c % 25, "CITY") for c in range(5)],
        "supplier": [(1, "S", 0)],
        "part": [(p, f"p{p}", "B", ("SMALL", "PROMO")[p % 2], 3) for p in range(orders)],
        "orders": [(o, o % 5, "F", day, "1-URGENT") for o in range(orders)],
        "events": [(e, day, 2.0) for e in range(orders)],
    }
    tables = {name: frame(spark, kept, star_schema.TABLES[name]) for name, kept in rows.items()}
    for name, table in (tables | {"lineitem": lines(spark, orders)}).items():
        table.write.parquet(f"{folder}/{name}.parquet")
    return star_schema.read_star_sources(spark, str(folder))


def test_items_are_shuffled_once(spark, tmp_path, no_broadcast, monkeypatch):
    """From their numbering on they lie in their buckets; only ids go to the products."""
    plain, written = order_buckets._write, {}

    def write(rows, location, buckets):
        placed = rows.repartition(buckets, order_buckets.KEY).sortWithinPartitions(order_buckets.KEY)
        written[location.rpartition("/")[2]] = placed._jdf.queryExecution().executedPlan().toString()
        plain(rows, location, buckets)

    monkeypatch.setattr(order_buckets, "_write", write)
    sources = star_of(spark, tmp_path / "star", 20)
    stored = order_buckets.store(sources, str(tmp_path / "b"), buckets=3)
    assert written["items"].count("Window ") == 1
    assert shuffles_above(written["items"], "Window ") == []
    assert len(shuffles_above(written["orders"], "Window ")) == 1
    orders = plans.fact_orders(sources)
    assert records(order_buckets.fact_sales(stored)) == records(plans.fact_sales(sources, orders))


def test_items_keep_their_category_without_product_or_twice(spark, tmp_path, no_broadcast):
    shop = some_shop(8)
    for _ in range(2):
        shop.item("o1", 1, "lamp", "north", 5).item("o1", 1, None, "north", 5).item("o2", 9, "gone", None, 6)
        shop.item(None, 1, None, "north", 5)
    same_facts(spark, shop, str(tmp_path / "b"), SkewPolicy())
    stored = order_buckets.read(spark, str(tmp_path / "b"))
    sources = shop.sources(spark)
    items = plans.enriched_items(sources.order_items, plans.translated_products(sources.products, sources.category_translation))
    assert stored.items.bucketed.columns == items.columns
    assert records(stored.items.bucketed.unionByName(stored.items.loose)) == records(items)


def test_lines_without_an_order_are_numbered_as_before(spark):
    """Where none is without an order, lines are numbered by order alone."""
    loose = [(None, p, 1, n, 2.0, 10.0, 0.0, 0.0, "A", "F", None) for p in (3, 1) for n in range(4)]
    whole, mixed = (star_schema.order_items(lines(spark, 9, rows), SkewPolicy()) for rows in ((), loose))
    assert records(whole) == records(mixed.filter("order_id IS NOT NULL"))
    numbers = records(mixed.filter("order_id IS NULL"), "order_item_id")
    assert numbers == [(1,)] * 8
    assert "_chunk" not in whole._jdf.queryExecution().executedPlan().toString()


def test_settings_hold_inside_only(spark):
    before = spark.conf.get(PARTITIONS)
    with pytest.raises(ValueError), set_for(spark, {PARTITIONS: "3", **order_buckets._IN_BUCKETS}):
        assert spark.conf.get(PARTITIONS) == "3"
        raise ValueError
    assert spark.conf.get(PARTITIONS) == before
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", None) != "false"
