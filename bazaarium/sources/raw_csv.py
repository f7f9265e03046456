"""Raw CSV deliveries, read by column name with declared types."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from bazaarium import contracts
from bazaarium.contracts import Sources
from bazaarium.sources import csv_records, files

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def header(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Column names of a CSV without reading its rows."""
    return spark.read.options(**CSV_OPTIONS).csv(paths).columns


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    schema: StructType,
    name: str,
    *,
    multiline: bool = False,
    infer: bool = False,
) -> DataFrame:
    """Typed scan: contract columns get their types, further columns stay text.

    With `infer`, further columns get the types their values have, at the cost of
    reading the files once for it.

    A missing column raises here and lists what is missing; a malformed row, or
    a file of the set with another header, raises when the rows are read. Multi-line
    files are read in parallel too, see `csv_records`.
    """
    present = header(spark, paths)
    missing = [field for field in schema.names if field not in present]
    if missing:
        raise ValueError(f"Schema mismatch in {name}: missing columns {missing}")
    typed = {field.name: field for field in schema}
    if infer:
        found = spark.read.options(**CSV_OPTIONS, inferSchema=True).option("multiLine", multiline).csv(paths)
        typed = {field.name: field for field in found.schema} | typed
    actual = StructType([typed.get(column, StructField(column, StringType())) for column in present])
    if multiline:
        return csv_records.read(spark, paths, actual, CSV_OPTIONS, name)
    return (
        spark.read.options(**CSV_OPTIONS)
        .schema(actual)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .csv(paths)
    )


def read_sources(
    spark: SparkSession,
    folder: str,
    file_patterns: Mapping[str, str] = contracts.SOURCE_FILES,
) -> Sources:
    """The nine raw tables of a delivery folder.

    Each pattern may match one file or a folder of part files, which are read in parallel.
    Matches with different names are different deliveries, of which one must be chosen.
    """
    tables = {}
    for name, ddl in contracts.SOURCES.items():
        pattern = f"{folder.rstrip('/')}/{file_patterns[name]}"
        paths = files.matching(spark, pattern)
        if not paths:
            raise FileNotFoundError(f"No file for source {name}: {pattern}")
        if len(paths) > 1:
            raise ValueError(f"More than one delivery of source {name}: {paths}")
        tables[name] = read_csv(
            spark,
            paths,
            contracts.struct(ddl),
            name,
            multiline=name in contracts.MULTILINE_SOURCES,
            infer=name in contracts.INFERRED_SOURCES,
        )
    return Sources(**tables)
