"""Stored tables. Every write replaces the earlier one, so a rerun is harmless."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType

from bazaarium import contracts
from bazaarium.contracts import Model, Sources
from bazaarium.sources import files

# Fixed value: the folder name of rows without a month.
_NO_MONTH = "__HIVE_DEFAULT_PARTITION__"
MONTH_PARTITIONED = frozenset({"fact_orders", "fact_sales"})


def _location(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def write_table(rows: DataFrame, root: str, table: str) -> DataFrame:
    """Write one parquet table and return it as read back.

    Facts are laid out by purchase month. The rebalance hint brings a month's rows
    together but lets AQE split a month that holds most of them and merge small
    ones, so there are neither giant nor tiny files.
    """
    location = _location(root, table)
    if table in MONTH_PARTITIONED:
        rows = rows.hint("rebalance", "purchase_month")
        rows.write.mode("overwrite").partitionBy("purchase_month").parquet(location)
    else:
        rows.write.mode("overwrite").parquet(location)
    # The declared schema keeps the partition column's type and place.
    return rows.sparkSession.read.schema(rows.schema).parquet(location).select(*rows.columns)


def replace_months(rows: DataFrame, root: str, table: str, months: Sequence[str | None]) -> None:
    """Replace some months of a stored fact by these rows, which are of these months only.

    The files of all other months are left alone. A month that has no rows any more goes.
    The rows must not be read from the table itself.
    """
    spark, location = rows.sparkSession, _location(root, table)
    left = {row["purchase_month"] for row in rows.select("purchase_month").distinct().collect()}
    placed = rows.hint("rebalance", "purchase_month").write.mode("overwrite")
    if left:
        placed.option("partitionOverwriteMode", "dynamic").partitionBy("purchase_month").parquet(location)
    for month in set(months) - left:
        files.remove(spark, f"{location}/purchase_month={_NO_MONTH if month is None else month}")
    spark.catalog.refreshByPath(location)


def stage_sources(sources: Sources, root: str) -> Sources:
    """Store every source unchanged as `stg_<name>` and go on from the stored copy,
    so that text is parsed once."""
    staged = {name: write_table(rows, root, f"stg_{name}") for name, rows in sources.items()}
    return Sources(**staged)


def _read_table(spark: SparkSession, location: str) -> DataFrame:
    """A stored table; month partitions stay text, which Spark would take for dates."""
    found = spark.read.parquet(location).schema
    if "purchase_month" in found.names:
        found["purchase_month"].dataType = StringType()
    return spark.read.schema(found).parquet(location)


def read_model(spark: SparkSession, root: str) -> Model:
    """The stored model."""
    stored = {name: _read_table(spark, _location(root, name)) for name in Model.NAMES}
    for name, ddl in contracts.MODEL.items():
        stored[name] = stored[name].select(*contracts.columns(ddl))
    return Model(**stored)
