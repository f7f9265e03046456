"""The skew-proof operators against plain Spark or numpy on the same rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from conftest import records
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from bazaarium.functions.columns import (
    MICROS_PER_DAY,
    elapsed_days,
    elapsed_micros,
    magnitude_bucket,
    month_key,
    month_start,
)
from bazaarium.operators import ranking, skew
from bazaarium.operators.keys import orphan_rows, reference_checks, surplus_rows
from bazaarium.operators.quantile import exact_quantile
from bazaarium.operators.ranking import dense_rank_descending, number_within
from bazaarium.operators.skew import SkewPolicy, heavy_cells, hot_keys, salted_join
from bazaarium.session import configure, fit_partitions, planned_bytes

EAGER = SkewPolicy(rows_per_task=100)
EVERY = SkewPolicy(rows_per_task=0)
SHUFFLED = SkewPolicy(rows_per_task=3, local_keys=2)


@pytest.fixture(scope="module")
def skewed(spark):
    """900 rows, a third of them of key 7; some keys and some times are missing."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 != 1, F.col("id") % 40)
    hour = F.when(F.col("id") % 23 != 0, (F.col("id") * 37) % 60)
    time = F.timestamp_add("MINUTE", hour * 17, F.lit("2018-01-01").cast("timestamp_ntz"))
    rows = spark.range(900).select("id", key.alias("key"), time.alias("time"), (F.col("id") % 2).alias("kind"))
    return rows.repartition(5)


def test_hot_keys_are_exact_whatever_their_share(skewed):
    found = hot_keys(skewed, "key", EAGER)
    n = skewed.filter("key = 7").count()
    assert records(found.rows) == [(7, n)] and found.local
    assert hot_keys(skewed, "key", SkewPolicy()) is None
    every = hot_keys(skewed, "key", EVERY)
    assert every.rows.count() == skewed.filter("key IS NOT NULL").select("key").distinct().count()
    listed = hot_keys(skewed, "key", SHUFFLED)
    assert not listed.local  # too long a list for a broadcast
    assert records(listed.rows, "key") == records(skewed.groupBy("key").count().filter("key IS NOT NULL AND count > 3"), "key")


def test_many_heavy_cells_are_not_broadcast(skewed, monkeypatch):
    """Cells that can be heavy grow with the rows where a task should have few of them."""
    held = []
    monkeypatch.setattr(skew.F, "broadcast", lambda rows: held.append(rows.columns) or rows)
    expected = records(hot_keys(skewed, "key", SHUFFLED).rows)
    assert held == [["_cell"]]
    monkeypatch.setattr(skew, "LOCAL_CELLS", 2)
    found = hot_keys(skewed, "key", SHUFFLED)
    assert records(found.rows) == expected != [] and not found.local
    assert held == [["_cell"]]


def test_a_key_just_below_a_ten_thousandth_of_all_rows_is_split(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") < 19, -1).otherwise(F.col("id")).alias("key"), "id")
    found = hot_keys(rows, "key", SkewPolicy(rows_per_task=10))
    assert records(found.rows) == [(-1, 19)]
    lookup = spark.range(3).select((F.col("id") - 1).alias("key"))
    joined = salted_join(rows, lookup, "key", ["id"], found, "left_semi")
    assert joined.count() == 19


def test_finding_hot_keys_shuffles_no_row_for_each_key(spark):
    rows, policy = spark.range(0, 300_000, numPartitions=6), SkewPolicy(rows_per_task=1000)
    cells = 4096
    assert heavy_cells(rows, "id", cells, policy).count() == 0
    # What each task hands on: a count for each cell it met.
    handed = rows.select(F.spark_partition_id().alias("part"), F.pmod(F.xxhash64("id"), F.lit(cells)).alias("cell"))
    assert handed.distinct().count() <= 6 * cells < rows.count()
    assert hot_keys(rows, "id", policy) is None


@pytest.mark.parametrize("policy", [EAGER, SkewPolicy(), EVERY, SHUFFLED])
def test_numbering_equals_a_plain_window(skewed, policy):
    order = [F.col("time").asc_nulls_last(), F.col("id").asc()]
    plain = F.row_number().over(Window.partitionBy("key", "kind").orderBy(*order))
    expected = skewed.withColumn("n", F.when(F.col("key").isNotNull(), plain))
    moment = F.coalesce("time", F.lit("9999-12-31").cast("timestamp_ntz"))
    chunks = [F.date_trunc("HOUR", moment), moment, magnitude_bucket("id")]
    numbered = number_within(skewed, ["key", "kind"], order, chunks, hot_keys(skewed, "key", policy), "n")
    masked = numbered.withColumn("n", F.when(F.col("key").isNotNull(), F.col("n")))
    assert records(masked) == records(expected)


def test_rows_of_one_moment_are_split_by_id(spark):
    rows = spark.range(5000).select(F.lit(1).alias("key"), F.lit(None).cast("timestamp_ntz").alias("time"), "id")
    policy = SkewPolicy(rows_per_task=50)
    moment = F.coalesce("time", F.lit("9999-12-31").cast("timestamp_ntz"))
    chunks = [F.date_trunc("DAY", moment), moment, magnitude_bucket("id")]
    hot = hot_keys(rows, "key", policy)
    numbered = number_within(rows, ["key"], [F.col("time"), F.col("id")], chunks, hot, "n")
    assert numbered.filter("n <> id + 1").count() == 0
    marked = ranking.mark_hot(rows, hot)
    sizes = ranking._chunked(marked, ["key"], chunks, hot).groupBy("_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 50 and sizes.count() >= 100


def test_unused_number_costs_nothing(skewed):
    hot = hot_keys(skewed, "key", EAGER)
    numbered = number_within(skewed, ["key"], [F.col("id")], [F.col("id")], hot, "n")
    plan = numbered.groupBy("kind").count()._jdf.queryExecution().optimizedPlan().toString()
    # What is left is the small broadcast that marks hot keys.
    assert "Window" not in plan and plan.count("Join") == 1


@pytest.mark.parametrize("how", ["left", "left_semi"])
@pytest.mark.parametrize("policy", [EAGER, EVERY, SHUFFLED])
def test_salted_join_equals_a_plain_join(spark, skewed, how, policy):
    lookup = spark.range(30).select(F.col("id").alias("key"), (F.col("id") * 10).alias("value"))
    salted = salted_join(skewed, lookup, "key", ["id"], hot_keys(skewed, "key", policy), how)
    plain = skewed.join(lookup, "key", how)
    assert records(salted, *sorted(plain.columns)) == records(plain, *sorted(plain.columns))


def test_salted_join_spreads_the_hot_key_as_far_as_its_count_asks(spark, skewed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    lookup = spark.range(30).select(F.col("id").alias("key"))
    hot = hot_keys(skewed, "key", EAGER)
    joined = salted_join(skewed, lookup, "key", ["id"], hot)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = re.findall(r"hashpartitioning\(([^)]*)", plan)
    assert sum("_salt" in keys for keys in shuffles) == 2
    ((rows, tasks),) = records(hot.rows.select("_rows", hot.tasks().alias("tasks")))
    assert tasks == -(-rows // 100) > 1


def test_a_submitted_number_of_partitions_survives(spark):
    options = configure(SparkSession.builder.config("spark.sql.shuffle.partitions", "4000"))._options
    assert options.get("spark.sql.shuffle.partitions") == "4000"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4000")
    assert fit_partitions(spark, 10**9) == 4000
    assert fit_partitions(spark, 10**13) == 49671 == int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 0 < planned_bytes([spark.range(1000)]) < 10**6


def test_dense_rank_equals_a_plain_window(spark):
    random.seed(3)
    values = [random.choice([0, 1, 5, 4096, 10**9, None, -3, random.randrange(10**6)]) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(values)), "id int, v bigint")
    plain = F.dense_rank().over(Window.orderBy(F.col("v").desc_nulls_last()))
    assert records(dense_rank_descending(rows, "v", "place")) == records(rows.withColumn("place", plain))


def test_buckets_keep_the_order(spark):
    edges = [v for p in range(62) for v in (2**p - 1, 2**p, 2**p + 1)]
    values = sorted({s * v for v in edges for s in (1, -1)})
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    buckets = [row.b for row in rows.select("v", magnitude_bucket("v").alias("b")).orderBy("v").collect()]
    assert buckets == sorted(buckets)
    assert max(buckets) < 4096 * 51


@pytest.mark.parametrize("q", [0.0, 0.25, 0.75, 0.9, 1.0])
def test_quantile_is_exact(spark, q):
    random.seed(5)
    samples = {
        "one": [42],
        "tied": [100] * 90 + [7] * 10,
        "far apart": [1, 2, 4, 10, 10**12],
        "many": [random.randrange(10**7) for _ in range(501)] + [0] * 7,
    }
    for name, values in samples.items():
        rows = spark.createDataFrame([(v,) for v in [*values, None]], "v bigint")
        assert exact_quantile(rows, "v", q, "x").first().x == pytest.approx(np.quantile(values, q)), name


def test_quantile_of_nothing_is_null(spark):
    assert exact_quantile(spark.range(0), "id", 0.5, "x").first().x is None


def test_month_keys_become_first_of_month(spark):
    rows = spark.createDataFrame([("2018-02",), ("2018-02-17",), ("",), (None,)], "m string")
    starts = [str(row.d) for row in rows.select(month_start(F.col("m")).alias("d")).collect()]
    assert starts == ["2018-02-01", "2018-02-01", "None", "None"]


def test_elapsed_time_is_the_same_in_every_session_zone(spark):
    # 02:41 does not exist in New York on that day; the year has a longer day too.
    times = "timestamp_ntz'1996-04-07 02:41:00' AS a, timestamp_ntz'1997-04-08 02:40:59.000001' AS b"
    gap = 366 * MICROS_PER_DAY - 999_999
    zone = spark.conf.get("spark.sql.session.timeZone")
    for session_zone in ("UTC", "America/New_York", "Australia/Lord_Howe"):
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        row = spark.sql(f"SELECT {times}").select(
            elapsed_micros(F.col("a"), F.col("b")).alias("after"),
            elapsed_micros(F.col("b"), F.col("a")).alias("before"),
            elapsed_days(F.col("a"), F.col("a")).alias("none"),
            month_key(F.col("a")).alias("month"),
        ).first()
        assert tuple(row) == (gap, -gap, 0.0, "1996-04")
    spark.conf.set("spark.sql.session.timeZone", zone)


def test_reference_checks_equal_counting_and_joining(spark):
    parents = spark.createDataFrame([(1,), (2,), (2,), (None,), (None,), (3,)], "k int")
    rows = spark.createDataFrame([(1, 5), (1, 5), (4, 2), (None, 3), (None, 1), (2, 7)], "k int, v int")
    found = reference_checks(parents, rows, "k", "surplus", "orphans", F.lit(1), {"v": F.col("v")})
    assert records(found, "surplus", "orphans", "v") == [(2, 3, 23)]
    assert records(surplus_rows(parents, ["k"], "n")) == [(2,)] and records(orphan_rows(rows, "k", parents, "n")) == [(3,)]
    assert records(reference_checks(parents, rows, "k", "surplus", "orphans", F.col("v")), "orphans") == [(6,)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    none = reference_checks(parents.limit(0), rows.limit(0), "k", "surplus", "orphans", F.lit(1))
    assert records(none) == [(0, 0)]
