"""Registered queries: each reads the given tables whole and returns a DataFrame.

The library returns exact decimals and unrounded ratios. `_plain` renders them so
that two engines can be compared value by value; see `oracles.py`.
"""

from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable
from datetime import date, datetime
from functools import lru_cache, reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.types import StructType  # noqa: E402

import oracles  # noqa: E402
from bazaarium.contracts import MODEL, Model, Sources, columns  # noqa: E402
from bazaarium.functions.columns import month_start  # noqa: E402
from bazaarium.operators.keys import orphan_rows, surplus_rows  # noqa: E402
from bazaarium.operators.skew import SkewPolicy  # noqa: E402
from bazaarium.plans import cube, headline, marts, measures, model as plans, order_buckets  # noqa: E402
from bazaarium.plans import quality, questions, refresh, repeat_curve, sketches  # noqa: E402
from bazaarium.plans.headline import HeadlineParameters  # noqa: E402
from bazaarium.plans.measures import Selection  # noqa: E402
from bazaarium.sinks import tables  # noqa: E402
from bazaarium.session import fit_tasks, scanned_bytes  # noqa: E402
from bazaarium.sinks.reports import export_report_tables  # noqa: E402
from bazaarium.sources import csv_records, files, fingerprint_tree  # noqa: E402
from bazaarium.sources.raw_csv import CSV_OPTIONS  # noqa: E402
from bazaarium.sources.report_files import check_report_table, fingerprint, read_report_table  # noqa: E402
from bazaarium.sources.star_schema import ITEM_SPREAD, TABLES, read_star_sources  # noqa: E402

# Until then orders are in the first delivery of `orders_after_delivery`.
DELIVERED_UNTIL = datetime(2000, 7, 1)
# Parameters that suit the keys and dates of the given tables.
HEADLINE = HeadlineParameters(
    prior_year=2000, current_year=2001, named_states=("NATION_0", "NATION_1", "NATION_2")
)
YEAR_2000 = (date(2000, 1, 1), date(2000, 12, 31))
ONE_DAY, NEXT_DAY = (date(2000, 3, 1),) * 2, (date(2000, 3, 2),) * 2
PRIOR = (date(2000, 1, 1), date(2000, 7, 31))
CURRENT = (date(2001, 1, 1), date(2001, 7, 31))
TWO_STATES = Selection(period=YEAR_2000, states=("NATION_1", "NATION_5"))
TWO_CATEGORIES = Selection(
    period=YEAR_2000, states=("NATION_1", "NATION_5"), categories=("medium", "small")
)
TWO_SEGMENTS = Selection(segments=("Active repeat", "At-risk high-value"))
TWO_HOMES = Selection(home_states=("NATION_1", "NATION_5"))
ONE_CITY = Selection(home_cities=("BUILDING",))
FEW_GOODS = Selection(products=range(1, 101), sellers=(1, 2, 3, 5, 8))


def _plain(rows: DataFrame) -> DataFrame:
    """Amounts and ratios as doubles with 6 places, whole numbers as bigint, times as text."""
    shown = []
    for name, kind in rows.dtypes:
        column = F.col(name)
        if kind == "double" or kind == "float" or kind.startswith("decimal"):
            column = F.round(column.cast("double"), 6)
        elif kind in ("tinyint", "smallint", "int"):
            column = column.cast("bigint")
        elif kind.startswith("timestamp"):
            column = F.substring(column.cast("string"), 1, 19)
        elif kind == "date":
            column = column.cast("string")
        shown.append(column.alias(name))
    return rows.select(*shown)


def _sources(spark: SparkSession, folder: str, policy: SkewPolicy = SkewPolicy()) -> Sources:
    """The sources, with the session's tasks cut to the size of the tables."""
    stored = [spark.read.schema(ddl).parquet(f"{folder}/{name}.parquet") for name, ddl in TABLES.items()]
    fit_tasks(spark, sum(scanned_bytes(rows) for rows in stored))
    return read_star_sources(spark, folder, policy)


@lru_cache(maxsize=4)
def planned(spark: SparkSession, folder: str) -> tuple[Sources, Model]:
    """Plans only, no data: queries of one session share the planning of the facts."""
    sources = _sources(spark, folder)
    return sources, plans.build_model(sources, item_spread=ITEM_SPREAD)


@lru_cache(maxsize=4)
def with_facts(spark: SparkSession, folder: str) -> Model:
    """The model with both facts stored when they are first used, and all else made from them."""
    root = files.scratch(spark, "facts")

    def keep(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{root}/{name}", compression="zstd")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    return plans.build_model(planned(spark, folder)[0], item_spread=ITEM_SPREAD, keep=keep)


def _from_sources(plan: Callable[[Sources], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _plain(plan(planned(spark, folder)[0]))

    return query


def _from_model(plan: Callable[[Model], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _plain(plan(planned(spark, folder)[1]))

    return query


def _products(sources: Sources) -> DataFrame:
    return plans.translated_products(sources.products, sources.category_translation)


def _sequence(model: Model) -> DataFrame:
    return model.fact_orders.select(
        "order_id",
        "customer_unique_id",
        "is_delivered",
        "customer_delivered_order_number",
        "first_observed_delivered_order_flag",
    )


def _month_keys(model: Model) -> DataFrame:
    month = month_start(F.col("purchase_month")).alias("month_start")
    return model.fact_orders.groupBy("purchase_month", month).agg(F.count("*").alias("orders"))


def _canonical(rows: DataFrame) -> DataFrame:
    """Values that two engines write as the same text: fractions as whole millionths."""
    shown = []
    for name, kind in rows.dtypes:
        column = F.col(name)
        if kind in ("double", "float") or kind.startswith("decimal"):
            column = F.round(column.cast("double") * 1_000_000).cast("bigint")
        elif kind.startswith("timestamp"):
            column = F.substring(column.cast("string"), 1, 19)
        shown.append(column.alias(name))
    return rows.select(*shown)


def _fingerprints(model: Model) -> DataFrame:
    """All seven model tables, every column."""
    prints = [fingerprint(_canonical(getattr(model, t).select(*columns(MODEL[t]))), t) for t in MODEL]
    return reduce(DataFrame.unionByName, prints)


def _read_back(spark: SparkSession, folder: str) -> DataFrame:
    """The seven report tables: exported as CSV, checked against the contract, read with report types."""
    target = files.scratch(spark, "report-tables")
    export_report_tables(with_facts(spark, folder), target, compression="gzip")
    found = []
    for table in MODEL:
        checked = check_report_table(spark, target, table)
        rows = read_report_table(spark, target, table)
        names = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
        counted = rows.agg(F.count("*").alias("row_count")).filter(F.col("row_count") == checked)
        found.append(counted.select(F.lit(table).alias("table_name"), "row_count", F.lit(names).alias("columns")))
    return reduce(DataFrame.unionByName, found)


def _gate_report(spark: SparkSession, folder: str) -> DataFrame:
    """The gate's operators on columns of the given tables that do not pass."""

    def table(name: str) -> DataFrame:
        return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")

    lines, orders = table("lineitem"), table("orders")
    finished = orders.filter("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    customers = table("customer").withColumnRenamed("c_custkey", "o_custkey")
    checks = [
        surplus_rows(lines, ["l_orderkey", "l_linenumber"], "repeated_line_numbers"),
        surplus_rows(lines, ["l_orderkey", "l_suppkey"], "repeated_suppliers_of_an_order"),
        orphan_rows(lines, "l_orderkey", finished, "lines_of_unfinished_orders"),
        orphan_rows(orders, "o_custkey", customers, "orders_of_unknown_customers"),
    ]
    return quality.gate_report(quality.as_checks(checks))


def _csv_read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations, whose texts hold quotes and line breaks, written as CSV and read by many tasks a file."""
    told = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    path = files.scratch(spark, "conversations-csv")
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "quoteAll": True}
    # A line break beside what the texts hold, so that every record has several lines.
    broken = told.withColumn("text", F.concat(F.lit('"'), "role", F.lit('"\n'), "text"))
    broken.write.options(**CSV_OPTIONS, **kept).csv(path)
    names = ", ".join(f"{name} {kind}" for name, kind in told.dtypes)
    read = csv_records.read(spark, path, StructType.fromDDL(names), CSV_OPTIONS, "conversations")
    return read.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@lru_cache(maxsize=4)
def cubed(spark: SparkSession, folder: str) -> tuple[cube.Cube, Model]:
    """The stored facts and the cube made from them."""
    root, model = files.scratch(spark, "cube"), with_facts(spark, folder)
    given = {name: getattr(model, name) for name in Model.NAMES}
    given["mart_customer_rfm"] = tables.write_table(given["mart_customer_rfm"], root, "mart_customer_rfm")
    stored = Model(**given)
    cube.build(stored, f"{root}/cube")
    return cube.read(spark, f"{root}/cube"), stored


def _from_cube(ask: Callable[[cube.Cube, Model], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _plain(ask(*cubed(spark, folder)))

    return query


@lru_cache(maxsize=4)
def bucketed(spark: SparkSession, folder: str) -> order_buckets.OrderBuckets:
    """The sources stored in buckets by order."""
    return order_buckets.store(planned(spark, folder)[0], files.scratch(spark, "order-buckets"))


@lru_cache(maxsize=4)
def sketched(spark: SparkSession, folder: str) -> DataFrame:
    """The stored sketches of customers by month and state."""
    path = files.scratch(spark, "sketches")
    sketches.monthly(planned(spark, folder)[1]).write.parquet(path)
    return spark.read.parquet(path)


def _active_by_state(spark: SparkSession, folder: str) -> DataFrame:
    """Exact figures; the estimates beside them are held against their bound, as they may vary in it."""
    found = sketches.active_by_state(planned(spark, folder)[1], sketched(spark, folder))
    return _plain(found.drop("estimated_customers"))


def _returning_by_month(spark: SparkSession, folder: str) -> DataFrame:
    found = sketches.returning_by_month(planned(spark, folder)[1], sketched(spark, folder))
    return _plain(found.drop("estimated_both", "estimated_either"))


def _first_delivery(sources: Sources) -> tuple[DataFrame, DataFrame]:
    """Orders as they were known at one time, and those of them or later ones that differ now."""
    orders, until = sources.orders, F.lit(DELIVERED_UNTIL).cast("timestamp_ntz")
    arrived = F.col("order_delivered_customer_date")
    open_then = F.coalesce(arrived >= until, F.lit(False))
    late = orders.filter((F.col("order_purchase_timestamp") >= until) | open_then)
    known = (
        orders.filter(F.coalesce(F.col("order_purchase_timestamp") < until, F.lit(True)))
        .withColumn("order_status", F.when(open_then, "shipped").otherwise(F.col("order_status")))
        .withColumn("order_delivered_customer_date", F.when(~open_then, arrived))
    )
    return known, late


def _changed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Which orders of the first delivery differ from what is known now, by trees of fingerprints."""
    now = planned(spark, folder)[0].orders
    then, _ = _first_delivery(planned(spark, folder)[0])
    trees = []
    for rows in (then, now):
        trees.append(files.scratch(spark, "orders-tree"))
        fingerprint_tree.store(rows, ["order_id"], trees[-1])
    return _plain(fingerprint_tree.differing_keys(spark, *trees))


@lru_cache(maxsize=4)
def after_delivery(spark: SparkSession, folder: str) -> Model:
    """The stored model of the orders as known at one time, refreshed by all that came later."""
    # Stored once, as the job does, so that neither delivery numbers the items again.
    sources = tables.stage_sources(planned(spark, folder)[0], files.scratch(spark, "staged"))
    known, late = _first_delivery(sources)
    root = files.scratch(spark, "model")
    first = plans.build_model(
        refresh.restricted(sources, known), item_spread=ITEM_SPREAD, keep=lambda rows, name: tables.write_table(rows, root, name)
    )
    for name, rows in first.items():
        if name not in tables.MONTH_PARTITIONED:
            tables.write_table(rows, root, name)
    refresh.refresh(spark, root, refresh.restricted(sources, late), files.scratch(spark, "refresh"), item_spread=ITEM_SPREAD)
    return tables.read_model(spark, root)


@lru_cache(maxsize=4)
def split(spark: SparkSession, folder: str) -> Model:
    """The model as it is planned where many customers and orders are too large for one task."""
    policy = SkewPolicy(rows_per_task=4)
    return plans.build_model(_sources(spark, folder, policy), policy, ITEM_SPREAD)


def _of_llm(name: str) -> dict:
    """Queries, or SQL, of the subpackage llm and of the pipeline, where they are installed."""
    found = {}
    for module in ("bazaarium.llm.queries", "corpus_pipeline"):
        try:
            found.update(getattr(importlib.import_module(module), name)())
        except ModuleNotFoundError as error:
            if not (error.name or "").startswith(("bazaarium.llm", "corpus_pipeline")):
                raise
    return found


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the monthly executive mart."""
    return queries()["mart_executive_monthly"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from_sources = {
        "src_row_counts": quality.source_row_counts,
        "join_cardinality": quality.join_cardinality,
        "dq_raw_checks": quality.raw_checks,
        "item_enriched": lambda s: plans.enriched_items(s.order_items, _products(s)),
        "item_order": lambda s: plans.item_order(s.order_items, _products(s)),
        "payment_order": lambda s: plans.payment_order(s.order_payments).drop("primary_payment_type"),
        "primary_payment": lambda s: plans.payment_order(s.order_payments).select(
            "order_id", "primary_payment_type"
        ),
        "review_order": lambda s: plans.review_order(s.order_reviews),
    }
    from_model = {
        "dq_gmv_reconciliation": questions.gmv_reconciliation,
        "dq_model_checks": lambda m: quality.model_checks(m.fact_orders, m.fact_sales),
        "typed_month_key": _month_keys,
        "fact_orders": lambda m: m.fact_orders,
        "delivered_order_sequence": _sequence,
        "fact_sales": lambda m: m.fact_sales,
        "dim_customer": lambda m: m.dim_customer,
        "dim_product": lambda m: m.dim_product,
        "dim_seller": lambda m: m.dim_seller,
        "dim_date": lambda m: m.dim_date,
        "rfm_threshold": lambda m: plans.high_value_threshold(m.fact_orders),
        "customer_rfm": lambda m: m.mart_customer_rfm,
        **marts.MARTS,
        "top_categories_by_state": questions.top_categories_by_state,
        "seller_scorecard": questions.seller_scorecard,
        "review_by_delay_band": questions.review_by_delay_band,
        "monthly_gmv_mom": questions.monthly_gmv_change,
        "headline_overall": headline.overall,
        "headline_repeat": headline.repeat,
        "headline_growth": lambda m: headline.growth(m, HEADLINE),
        "headline_delivery": headline.delivery,
        "headline_retention": lambda m: headline.retention(m, HEADLINE),
        "headline_rfm": headline.rfm_opportunity,
        "headline_geography": lambda m: headline.geography(m, HEADLINE),
        "sel_state_period_totals": lambda m: measures.totals(m, TWO_STATES),
        "sel_segment_totals": lambda m: measures.totals(m, TWO_SEGMENTS),
        "sel_repeat_rate_by_month": lambda m: measures.repeat_rate(
            m, Selection(period=YEAR_2000), by=["purchase_month"]
        ),
        "sel_growth_by_state": lambda m: measures.growth(m, PRIOR, CURRENT),
        "sel_growth_by_state_day": lambda m: measures.growth(m, ONE_DAY, NEXT_DAY),
        "growth_drivers": lambda m: measures.growth_drivers(m, PRIOR, CURRENT),
        "sel_state_vs_benchmark": lambda m: measures.state_vs_benchmark(m, Selection(period=YEAR_2000)),
        "sel_first_repeat_gmv": lambda m: measures.first_repeat_gmv(m, TWO_STATES),
        "sel_category_first_repeat_gmv": lambda m: measures.first_repeat_gmv(m, TWO_CATEGORIES),
        "sel_home_state_gmv": lambda m: measures.select_sales(m, TWO_HOMES)
        .groupBy("seller_id")
        .agg(F.sum("price").alias("delivered_gmv")),
        "sel_home_city_gmv": lambda m: measures.select_sales(m, ONE_CITY)
        .groupBy(F.col("product_category_name_english").alias("category"))
        .agg(F.sum("price").alias("delivered_gmv")),
        "sel_product_seller_gmv": lambda m: measures.select_sales(m, FEW_GOODS)
        .groupBy("customer_state")
        .agg(F.sum("price").alias("delivered_gmv")),
        "observed_repeat_pct": measures.observed_repeat_pct,
        "top10_categories": measures.top_categories,
        "top7_states": measures.top_states,
        "repeat_curve": repeat_curve.repeat_curve,
        "repeat_windows_from_curve": lambda m: repeat_curve.windows_of(repeat_curve.repeat_curve(m)),
    }
    registered = {name: _from_sources(plan) for name, plan in from_sources.items()}
    registered.update({name: _from_model(plan) for name, plan in from_model.items()})
    registered["table_fingerprints"] = lambda spark, folder: _plain(_fingerprints(with_facts(spark, folder)))
    registered["gate_report"] = _gate_report
    registered["report_tables_read_back"] = _read_back
    registered["delivered_order_sequence_split"] = lambda spark, folder: _plain(_sequence(split(spark, folder)))
    registered["fact_sales_split"] = lambda spark, folder: _plain(split(spark, folder).fact_sales)
    registered["conversations_csv_read_back"] = _csv_read_back
    for table in ("fact_orders", "fact_sales", "dim_customer", "mart_customer_rfm"):
        registered[f"{table}_after_delivery"] = lambda spark, folder, table=table: _plain(getattr(after_delivery(spark, folder), table))
    registered["fact_orders_from_buckets"] = lambda spark, folder: _plain(order_buckets.fact_orders(bucketed(spark, folder)))
    registered["fact_sales_from_buckets"] = lambda spark, folder: _plain(
        order_buckets.fact_sales(bucketed(spark, folder), ITEM_SPREAD)
    )
    registered["orders_changed_since_delivery"] = _changed_orders
    registered["active_by_state_sketched"] = _active_by_state
    registered["returning_by_month_sketched"] = _returning_by_month
    from_cube = {
        "sel_totals_from_cube": lambda c, m: cube.totals(c, m, TWO_STATES),
        "sel_segment_totals_from_cube": lambda c, m: cube.totals(c, m, TWO_SEGMENTS),
        "sel_repeat_rate_by_month_from_cube": lambda c, m: cube.repeat_rate(c, m, Selection(period=YEAR_2000), ("purchase_month",)),
    }
    registered.update({name: _from_cube(ask) for name, ask in from_cube.items()})
    return registered | _of_llm("queries")


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | _of_llm("oracle_sql")
