"""Where two copies of a table differ, found through fingerprints of hash ranges.

`store` lays the rows of a table out by ranges of a hash of their key: folders for coarse
ranges, and inside them rows in the order of fine ranges, so that the files' statistics
tell which fine ranges they hold. Beside them it keeps one fingerprint for each fine
range; a coarse range's fingerprint is their sum, and the table's that of all.

`differing_keys` compares the coarse fingerprints first, reads the fine ones of coarse
ranges that differ, and only then the rows of fine ranges that differ. Equal ranges are
not read again. Rows are counted by key and content, so lost, added, repeated and changed
rows are told apart whatever their order, and a key with very many rows is aggregated on
the map side. Null keys are equal to each other.

A fingerprint adds 60 bits of each row's MD5. That two different ranges have one sum by
chance takes about 2^-60.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bazaarium.sources import files

#: Coarse ranges are folders; their number is fixed, so two copies agree on it.
COARSE_BITS = 6
#: Fine ranges: 2 ** 20 of them hold 100,000 rows each of 10^11.
FINE_BITS = 20
#: So many differing fine ranges are handed to the scan as a filter; more are joined.
LISTED_RANGES = 1000

_COARSE, _FINE, _DIGEST = "_coarse", "_fine", "_digest"


def _text(name: str) -> Column:
    """A value as text that no other value has: null is not a text, and ends are marked."""
    value = F.col(f"`{name}`").cast("string")
    return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _digest(names: Sequence[str]) -> Column:
    return F.md5(F.concat(*[_text(name) for name in names]))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("row_count").alias("row_count"), F.sum("content_sum").alias("content_sum"))


def store(rows: DataFrame, key: Sequence[str], root: str, fine_bits: int = FINE_BITS) -> None:
    """Write `rows` by hash range with their fingerprints under `root`, a new folder.

    One shuffle, by fine range; a coarse range with most rows is split by AQE.
    """
    if any(name in (_COARSE, _FINE, _DIGEST) for name in rows.columns):
        raise ValueError(f"columns named {_COARSE}, {_FINE} or {_DIGEST} are reserved")
    place = F.shiftrightunsigned(F.xxhash64(*[_text(name) for name in key]), 64 - fine_bits).cast("int")
    columns = {_FINE: place, _DIGEST: _digest(rows.columns)}
    placed = rows.withColumns(columns).withColumn(_COARSE, F.shiftright(_FINE, max(fine_bits - COARSE_BITS, 0)))
    by_range = placed.hint("rebalance", _COARSE).sortWithinPartitions(_COARSE, _FINE)
    by_range.write.partitionBy(_COARSE).parquet(f"{root}/rows")
    stored = rows.sparkSession.read.schema(placed.schema).parquet(f"{root}/rows")
    prints = stored.groupBy(_COARSE, _FINE).agg(
        F.count("*").alias("row_count"), F.sum(_number(F.col(_DIGEST))).cast("decimal(38,0)").alias("content_sum")
    )
    prints.hint("rebalance", _COARSE).write.partitionBy(_COARSE).parquet(f"{root}/prints")
    _sums(rows.sparkSession.read.schema(prints.schema).parquet(f"{root}/prints"), _COARSE).coalesce(1).write.parquet(
        f"{root}/coarse"
    )
    keys = rows.limit(0).select(*[f"`{name}`" for name in key])
    # Written last: a folder with these two is complete.
    files.write_text(rows.sparkSession, f"{root}/key.json", keys.schema.json())
    files.write_text(rows.sparkSession, f"{root}/rows.json", placed.schema.json())


def _unequal(first: DataFrame, second: DataFrame, by: str) -> DataFrame:
    """Ranges whose fingerprints differ, or that one side lacks."""
    one, two = (side.select(by, F.struct("row_count", "content_sum").alias(n)) for side, n in ((first, "_a"), (second, "_b")))
    return one.join(two, by, "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(by)


def differing_ranges(spark: SparkSession, first: str, second: str) -> tuple[list[int], DataFrame]:
    """Coarse ranges that differ, 64 at most, and a frame of the fine ranges that do."""
    tops = _unequal(spark.read.parquet(f"{first}/coarse"), spark.read.parquet(f"{second}/coarse"), _COARSE)
    coarse = sorted(row[_COARSE] for row in tops.collect())
    sides = [_prints(spark, root).filter(F.col(_COARSE).isin(coarse)) for root in (first, second)]
    return coarse, _unequal(*sides, _FINE)


def _prints(spark: SparkSession, root: str) -> DataFrame:
    ddl = f"{_FINE} int, row_count bigint, content_sum decimal(38,0), {_COARSE} int"
    return spark.read.schema(ddl).parquet(f"{root}/prints")


def _rows(spark: SparkSession, root: str) -> DataFrame:
    schema = StructType.fromJson(_json(spark, f"{root}/rows.json"))
    return spark.read.schema(schema).parquet(f"{root}/rows")


def _json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def differing_rows(spark: SparkSession, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables in fine ranges that differ, and no others.

    A short list of ranges reaches the scan, where it prunes folders and files; a long one
    is joined.
    """
    coarse, fine = differing_ranges(spark, first, second)
    listed = [row[_FINE] for row in fine.limit(LISTED_RANGES + 1).collect()]

    def chosen(root: str) -> DataFrame:
        inside = _rows(spark, root).filter(F.col(_COARSE).isin(coarse))
        if len(listed) <= LISTED_RANGES:
            return inside.filter(F.col(_FINE).isin(sorted(listed)))
        return inside.join(fine, _FINE, "left_semi")

    return chosen(first), chosen(second)


def differing_keys(spark: SparkSession, first: str, second: str) -> DataFrame:
    """One row for each key whose rows are not the same in both stored tables.

    Columns: the key, `difference` (`only first`, `only second`, `repeated` where the same
    contents occur but not equally often, else `changed`), and the key's rows on each side.
    """
    keys = [field["name"] for field in _json(spark, f"{first}/key.json")["fields"]]
    if keys != [field["name"] for field in _json(spark, f"{second}/key.json")["fields"]]:
        raise ValueError("the two tables are keyed by different columns")
    named = [F.col(f"`{name}`") for name in keys]
    sides = differing_rows(spark, first, second)
    counted = [
        side.groupBy(*named, _DIGEST).agg(F.count_if(F.lit(which == 0)).alias("_a"), F.count_if(F.lit(which == 1)).alias("_b"))
        for which, side in enumerate(sides)
    ]
    contents = counted[0].unionByName(counted[1]).groupBy(*named, _DIGEST).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    per_key = contents.groupBy(*named).agg(
        F.sum("_a").alias("first_rows"),
        F.sum("_b").alias("second_rows"),
        F.count_if(F.col("_a") != F.col("_b")).alias("_unequal"),
        F.count_if((F.col("_a") == 0) | (F.col("_b") == 0)).alias("_foreign"),
    )
    difference = (
        F.when(F.col("second_rows") == 0, "only first")
        .when(F.col("first_rows") == 0, "only second")
        .when(F.col("_foreign") == 0, "repeated")
        .otherwise("changed")
    )
    return per_key.filter("_unequal > 0").select(*named, difference.alias("difference"), "first_rows", "second_rows")
