"""Registered queries on the smallest given tables: results, plans, invariants."""

from __future__ import annotations

import re

import duckdb
import pytest
from conftest import records

import __spark_entry__ as registered
from bazaarium.contracts import MODEL, Model
from bazaarium.operators.skew import SkewPolicy
from bazaarium.plans import headline, marts, measures, questions
from bazaarium.plans.model import build_model
from bazaarium.sinks import tables
from bazaarium.sources.report_files import fingerprint
from bazaarium.sources.star_schema import ITEM_SPREAD, TABLES, read_star_sources

# Registered by the optional subpackage, which has tests of its own.
OPTIONAL = re.compile(r"op\d+_|pipeline$")
COMPARED = sorted(name for name in registered.queries() if not OPTIONAL.match(name))


@pytest.fixture(scope="module")
def model(spark, star_folder, tmp_path_factory) -> Model:
    """The model of the smallest tables, stored as a job would store it."""
    planned = build_model(read_star_sources(spark, star_folder), item_spread=ITEM_SPREAD)
    root = str(tmp_path_factory.mktemp("model"))
    for name in Model.NAMES:
        tables.write_table(getattr(planned, name), root, name)
    return tables.read_model(spark, root)


@pytest.fixture(scope="module")
def oracle(star_folder):
    connection = duckdb.connect()
    for table in (*TABLES, "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{star_folder}/{table}.parquet'")
    return connection


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_an_oracle():
    assert set(COMPARED) <= set(registered.oracle_sql()) <= set(registered.queries())


def test_entry_has_rows(spark, star_folder):
    assert registered.entry(spark).count() > 12


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_oracle(spark, star_folder, oracle, name):
    found = registered.queries()[name](spark, star_folder)
    columns = sorted(found.columns)
    sql = f"SELECT {', '.join(columns)} FROM ({registered.oracle_sql()[name]})"
    expected = sorted(oracle.execute(sql).fetchall(), key=repr)
    assert records(found, *columns) == expected
    assert expected or name == "sel_growth_by_state_day"  # few orders a day in the smallest tables


def test_plans_have_no_pairing_joins_and_no_python(spark, star_folder):
    for name in COMPARED:
        plan = _plan(registered.queries()[name](spark, star_folder))
        for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
            assert banned not in plan, (name, banned)


def test_unneeded_branches_are_not_planned(spark, star_folder):
    text = _plan(registered.queries()["mart_state_performance"](spark, star_folder))
    # Payments, categories and order numbers are not asked for.
    for unused in ("l_returnflag", "p_type", "Window", "l_linenumber"):
        assert unused not in text, unused


def test_plans_read_no_product_that_they_do_not_need(spark, star_folder):
    for name in ("sel_state_period_totals", "dq_gmv_reconciliation", "seller_scorecard"):
        assert "/part.parquet" not in _plan(registered.queries()[name](spark, star_folder)), name


def test_customers_are_valued_once_and_sellers_ranked_from_two_uses(spark, star_folder):
    found = registered.queries()["customer_rfm"](spark, star_folder)
    found.collect()
    plan = _plan(found)
    # The threshold and the last purchase are one subquery, and it reuses the customers' shuffles.
    assert "ReusedSubquery" in plan and "ReusedExchange" in plan
    plan = registered.queries()["seller_scorecard"](spark, star_folder)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[l_orderkey", plan)) <= 2


def test_building_a_selection_starts_no_job_after_the_facts_are_planned(spark, star_folder):
    chosen = [name for name in COMPARED if name.startswith("sel_")]
    for name in chosen:
        registered.queries()[name](spark, star_folder)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "")
    for name in chosen:
        registered.queries()[name](spark, star_folder)
    assert tracker.getJobIdsForGroup("planning") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_filters_and_columns_reach_the_stored_facts(spark, model):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    chosen = measures.Selection(period=registered.YEAR_2000, states=["NATION_1"])
    text = _plan(measures.top_categories(model, chosen))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(order_status,delivered)" in text
    assert "EqualTo(customer_state,NATION_1)" in text
    assert "PartitionFilters: [isnotnull(purchase_month" in text
    assert text.count("FileScan") == 1
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "seller_id" not in read and "freight_value" not in read


def test_results_depend_on_neither_salting_nor_partitions(spark, star_folder):
    eager = SkewPolicy(rows_per_task=1, local_keys=100_000)

    def prints(policy: SkewPolicy, partitions: int) -> list[tuple]:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        sources = read_star_sources(spark, star_folder, policy)
        planned = build_model(sources, policy, ITEM_SPREAD)
        found = []
        for table in ("fact_orders", "fact_sales", "mart_customer_rfm"):
            found += records(fingerprint(getattr(planned, table), table))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        return found

    plain = prints(SkewPolicy(), 1)
    assert prints(eager, 7) == plain
    assert prints(SkewPolicy(rows_per_task=2, local_keys=0), 3) == plain


def test_totals_agree_across_marts(model):
    gmv = float(headline.overall(model).first().delivered_gmv_brl)
    by_mart = {
        "months": marts.executive_monthly(model),
        "states": marts.state_performance(model),
        "categories": marts.category_performance(model),
    }
    for name, mart in by_mart.items():
        assert float(mart.agg({"delivered_gmv_brl": "sum"}).first()[0]) == pytest.approx(gmv), name
    assert records(questions.gmv_reconciliation(model)) == [(gmv, gmv, 0.0)]
    first, repeat = measures.first_repeat_gmv(model).first()
    assert float(first + repeat) == pytest.approx(gmv)


def test_customer_marts_agree(model):
    customers = marts.customer_lifecycle(model).count()
    segments = marts.rfm_segment_summary(model)
    assert segments.agg({"customers": "sum"}).first()[0] == customers
    assert segments.agg({"customer_share": "sum"}).first()[0] == pytest.approx(1)
    start = marts.cohort_retention(model).filter("cohort_period = 0")
    assert start.filter("retention_rate <> 1").count() == 0
    assert start.agg({"cohort_customers": "sum"}).first()[0] == customers
    eligible = [row.eligible_customers for row in marts.repeat_windows(model).orderBy("window_days").collect()]
    assert eligible == sorted(eligible, reverse=True)
    assert marts.payment_mix(model).agg({"payment_value_share": "sum"}).first()[0] == pytest.approx(1)


def test_stored_model_reads_back(spark, model):
    marts.register_views(model)
    months = spark.sql("SELECT count(*) AS n FROM mart_executive_monthly").first().n
    assert months == marts.executive_monthly(model).count() > 12
    assert dict(spark.table("fact_sales").dtypes)["purchase_month"] == "string"
    assert spark.table("fact_orders").columns == list(model.fact_orders.columns)
    assert set(MODEL) < set(Model.NAMES)
