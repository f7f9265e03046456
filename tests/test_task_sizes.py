"""Tasks stay small however large the tables are, and facts are derived once."""

from __future__ import annotations

import re

from conftest import Shop, records

from bazaarium.contracts import MODEL
from bazaarium.operators.skew import SkewPolicy
from bazaarium.plans import model as plans, order_buckets
from bazaarium.session import SHUFFLED_TASK_BYTES, TASK_BYTES, fit_tasks, set_for
from bazaarium.sinks.reports import export_report_tables
from bazaarium.sources.report_files import check_report_table, read_report_table

PARTITIONS = "spark.sql.shuffle.partitions"
MERGED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def shop() -> Shop:
    made = Shop()
    for i in range(12):
        kinds = (("boleto", 5 + i), ("voucher", 7), ("boleto", 2))[: 1 + i % 3]
        made.order(f"o{i}", f"p{i % 4}", f"2019-0{1 + i % 6}-05 10:00:00", prices=(i, 9, 9)[: i % 4], payments=kinds)
    return made


def plan_of(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_tasks_are_cut_to_the_stored_bytes(spark):
    session = spark.newSession()
    before = int(session.conf.get(PARTITIONS))
    assert fit_tasks(session, 1) == before
    assert fit_tasks(session, 6 * 10**9) >= 6 * 10**9 / TASK_BYTES
    assert int(session.conf.get(MERGED).rstrip("b")) == SHUFFLED_TASK_BYTES
    assert fit_tasks(session, 1) == int(session.conf.get(PARTITIONS)) > before
    chosen = spark.newSession()
    chosen.conf.set(MERGED, "3m")
    fit_tasks(chosen, 1)
    assert chosen.conf.get(MERGED) == "3m"


def test_a_bucket_stays_a_small_task_on_large_sources(spark, monkeypatch):
    counts = {}
    for size in (10**9, 6 * 10**9):
        monkeypatch.setattr(order_buckets, "scanned_bytes", lambda rows, size=size: size)
        counts[size] = order_buckets.bucket_count(shop().sources(spark))
        assert size / counts[size] <= 16 * 1024 * 1024
    assert counts[6 * 10**9] > 5 * counts[10**9]


def test_stored_facts_are_what_other_tables_read(spark, tmp_path):
    kept = []

    def keep(rows, name):
        kept.append(name)
        rows.write.parquet(str(tmp_path / name))
        return spark.read.schema(rows.schema).parquet(str(tmp_path / name))

    sources = shop().sources(spark)
    model, plain = plans.build_model(sources, keep=keep), plans.build_model(sources)
    for table in MODEL:
        assert records(getattr(model, table)) == records(getattr(plain, table)), table
    assert kept == ["fact_orders", "fact_sales"]
    for table in ("dim_customer", "dim_date", "mart_customer_rfm"):
        files = {name for path in getattr(model, table).inputFiles() for name in MODEL if f"/{name}/" in path}
        assert files == {"fact_orders"}, table


def test_rows_of_an_order_are_shuffled_once_unless_one_is_hot(spark):
    sources = shop().sources(spark)
    plain = plans.fact_orders(sources)
    split = plans.fact_orders(sources, SkewPolicy(rows_per_task=2))
    twice = re.compile(r"Exchange hashpartitioning\(order_id#\d+, (payment_type|seller_id)#")
    assert not twice.search(plan_of(plain))
    assert twice.search(plan_of(split))
    assert records(plain) == records(split) != []


def test_compressed_report_tables_read_as_plain_ones(spark, tmp_path):
    model = plans.build_model(shop().sources(spark))
    export_report_tables(model, str(tmp_path / "plain"))
    export_report_tables(model, str(tmp_path / "packed"), compression="gzip")
    assert list((tmp_path / "packed").glob("fact_sales.csv/*.csv.gz"))
    for table in MODEL:
        plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
        assert check_report_table(spark, plain, table) == check_report_table(spark, packed, table)
        assert records(read_report_table(spark, plain, table)) == records(read_report_table(spark, packed, table)), table


def odd_shop() -> Shop:
    """Items without an order or a product, of an unknown order or product, and twice the same."""
    made = shop()
    made.rows["products"].append(("vase", "cama", 31, 440, 3, 1250, 22, 35, 18))
    for order, number, product in ((None, 1, "lamp"), (None, 2, None), ("gone", 1, "lamp"), ("o3", 7, None), ("o3", 8, "vase"), ("o5", 9, "none")):
        made.item(order, number, product, "north", 4)
    made.item("o6", 10, "lamp", "north", 3).item("o6", 10, "lamp", "north", 3)
    return made


def test_kept_items_are_moved_by_order_alone(spark, tmp_path):
    seen = []

    def keep(rows, policy):
        seen.append(plan_of(rows))
        rows.write.parquet(str(tmp_path / f"sales-{policy.rows_per_task}"))
        return spark.read.schema(rows.schema).parquet(str(tmp_path / f"sales-{policy.rows_per_task}"))

    sources = odd_shop().sources(spark)
    orders = plans.fact_orders(sources)
    plain = plans.fact_sales(sources, orders)
    assert len(records(plain)) == sum(1 for _ in odd_shop().rows["order_items"])
    with set_for(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        for policy in (SkewPolicy(), SkewPolicy(rows_per_task=2)):
            kept = plans.fact_sales(sources, orders, policy, keep=lambda rows: keep(rows, policy))
            assert records(kept) == records(plain)
    usual, hot = seen
    ids_alone = re.compile(r"Exchange hashpartitioning\(product_id#[^\n]*\n[^\n]*\[order_id#\d+, product_id#\d+\]")
    assert ids_alone.search(usual) and not ids_alone.search(hot)
    assert not re.search(r"hashpartitioning\(order_id#\d+, product_id#", usual)
    # the setting holds only while the rows are stored
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_categories_of_an_order_are_shuffled_once_unless_one_is_hot(spark):
    sources = odd_shop().sources(spark)
    plain, split = plans.fact_orders(sources), plans.fact_orders(sources, SkewPolicy(rows_per_task=2))
    twice = re.compile(r"Exchange hashpartitioning\(order_id#\d+, product_category_name_english#")
    assert not twice.search(plan_of(plain))
    assert twice.search(plan_of(split))
    assert records(plain) == records(split) != []
