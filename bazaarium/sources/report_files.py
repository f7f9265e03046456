"""The seven exported report tables: typed re-read, contract check, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bazaarium import contracts
from bazaarium.functions.columns import month_start
from bazaarium.sources import fingerprint_tree
from bazaarium.sources.raw_csv import CSV_OPTIONS, header, read_csv

_BROKEN = "_broken_row"


def _location(folder: str, table: str) -> str:
    return f"{folder.rstrip('/')}/{table}.csv"


def read_report_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One exported CSV with report types; month keys become first-of-month dates."""
    schema = contracts.struct(contracts.MODEL[table])
    as_stored = StructType(
        [
            StructField(field.name, StringType()) if field.name in contracts.MONTH_KEYS else field
            for field in schema
        ]
    )
    rows = read_csv(spark, _location(folder, table), as_stored, table)
    months = {c: month_start(F.col(c)) for c in rows.columns if c in contracts.MONTH_KEYS}
    typed = rows.withColumns(months).select(*schema.names)
    return typed.withColumnsRenamed(contracts.REPORT_RENAMES.get(table, {}))


def check_report_table(spark: SparkSession, folder: str, table: str) -> int:
    """Check the exact header and the width of every row; return the row count."""
    expected = contracts.columns(contracts.MODEL[table])
    location = _location(folder, table)
    actual = header(spark, location)
    if actual != expected:
        raise ValueError(f"{table}: expected headers {expected}, got {actual}")
    text = StructType([StructField(c, StringType()) for c in [*expected, _BROKEN]])
    rows = (
        spark.read.options(**CSV_OPTIONS)
        .schema(text)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BROKEN)
        .csv(location)
    )
    # The checksum uses every column, so that the parser cannot skip unread ones.
    counted = rows.agg(
        F.count("*").alias("rows"),
        F.count(_BROKEN).alias("broken"),
        F.bit_xor(F.hash(*expected)).alias("checksum"),
    ).first()
    if counted["broken"]:
        raise ValueError(f"{table}: {counted['broken']} malformed rows")
    return counted["rows"]


def fingerprint(rows: DataFrame, table: str) -> DataFrame:
    """One row `(table_name, row_count, content_sum)`, independent of row order.

    The content sum adds 60 bits of each row's MD5, so a repeated or lost row shows.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in rows.columns]
    digest = F.substring(F.md5(F.concat_ws("\x1f", *texts)), 1, 15)
    number = F.conv(digest, 16, 10).cast("decimal(38,0)")
    return rows.agg(
        F.lit(table).alias("table_name"),
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("content_sum"),
    )


def inspect_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all seven tables after their contract check."""
    prints = None
    for table, ddl in contracts.MODEL.items():
        check_report_table(spark, folder, table)
        text = StructType([StructField(c, StringType()) for c in contracts.columns(ddl)])
        one = fingerprint(read_csv(spark, _location(folder, table), text, table), table)
        prints = one if prints is None else prints.unionByName(one)
    return prints


def require_same_folders(spark: SparkSession, first: str, second: str) -> None:
    """Raise unless both folders hold the same rows in all seven tables."""
    left = inspect_folder(spark, first)
    right = inspect_folder(spark, second)
    changed = left.exceptAll(right).unionByName(right.exceptAll(left))
    names = sorted({row["table_name"] for row in changed.select("table_name").collect()})
    if names:
        raise ValueError(f"Relocated files differ from the original files: {names}")


def differing_report_keys(spark: SparkSession, first: str, second: str, root: str) -> DataFrame:
    """`(table_name, key, difference, first_rows, second_rows)` of two folders' seven tables.

    Trees of fingerprints are kept under `root`, a new folder; only ranges of keys that
    differ are compared row by row. A key of several columns is joined by commas.
    """
    found = None
    for table, ddl in contracts.MODEL.items():
        text = StructType([StructField(c, StringType()) for c in contracts.columns(ddl)])
        trees = [f"{root.rstrip('/')}/{table}/{side}" for side in ("first", "second")]
        for folder, tree in zip((first, second), trees):
            rows = read_csv(spark, _location(folder, table), text, table)
            fingerprint_tree.store(rows, contracts.MODEL_KEYS[table], tree)
        differing = fingerprint_tree.differing_keys(spark, *trees)
        key = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in contracts.MODEL_KEYS[table]])
        one = differing.select(
            F.lit(table).alias("table_name"), key.alias("key"), "difference", "first_rows", "second_rows"
        )
        found = one if found is None else found.unionByName(one)
    return found
