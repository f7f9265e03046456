"""CSV files whose quoted fields hold line breaks, read by many tasks each.

The multi-line CSV reader gives a whole file to one task, because only the text before a
line break says whether it ends a record. Here lines are read as text, in blocks of files
as the scan cuts them, and a record is found by the parity of quotes before it:

1. every block counts its quotes, and how many of its lines would begin a record if the
   block itself began outside, or inside, a quoted field;
2. running sums over the blocks of a file, one row each, tell which of the two holds and
   how many records begin before the block;
3. inside a block the running parity numbers each line's record. A line that is a whole
   record goes on as it is; the lines of longer records, and the last line of a block,
   which the next block may continue, are brought together by (file, record);
4. each record is parsed on its own.

So the first shuffle is by block, whose size the scan bounds, and the second holds records
of several lines only. Parity also holds for doubled quotes; a quote inside a field that
is not quoted is not CSV, and a file that ends inside a quoted field raises. Blank lines
between records are skipped, and where a file's lines end in two characters, those breaks
become one character in fields as well, as the plain reader does it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BLOCK = ("file", "block")


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, line, text, quotes): every line with its place; a line belongs to the block it begins in."""
    read = spark.read.option("lineSep", "\n").text(paths)
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").alias("text"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
    )


def _before(value: Column, *order: str) -> Column:
    """The sum of a value over the rows of a partition that come before."""
    rows = Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(rows), F.lit(0))


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with `odd`, the parity of the block's quotes before them."""
    return lines.withColumn("odd", _before(F.col("quotes"), *_BLOCK, "line") % 2)


def _unended(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit("\r")), F.expr("left(text, length(text) - 1)")).otherwise(text)


def _heads(text: Column) -> Column:
    """The columns that a header names."""
    return F.transform(F.split(F.replace(text, F.lit('"'), F.lit("")), F.lit(",")), F.lower)


def _names(names: Sequence[str]) -> Column:
    return F.array(*(F.lit(name.lower()) for name in names))


def _blocks(placed: DataFrame, names: Sequence[str]) -> DataFrame:
    """(file, block, inside, records, crlf, other): whether a block begins inside a field, the records that
    begin before it, whether the file's first line ends with a carriage return, and whether it is a header of
    other columns; a blank one, or one that a quoted line break cuts, is not judged here."""
    counted = placed.groupBy(*_BLOCK).agg(
        F.sum("quotes").alias("quotes"),
        F.count_if(F.col("odd") == 0).alias("outside_starts"),
        F.count_if(F.col("odd") == 1).alias("inside_starts"),
        F.min_by("text", "line").alias("text"),
        F.min_by("quotes", "line").alias("first_quotes"),
    )
    first = _unended(F.col("text"))
    judged = (first != "") & (F.col("first_quotes") % 2 == 0)
    counted = counted.select(
        *_BLOCK,
        "quotes",
        "outside_starts",
        "inside_starts",
        F.endswith("text", F.lit("\r")).alias("ends"),
        (judged & (_heads(first) != _names(names))).alias("unlike"),
    )
    entered = counted.withColumn("inside", _before(F.col("quotes"), *_BLOCK) % 2)
    starts = F.when(F.col("inside") == 0, F.col("outside_starts")).otherwise(F.col("inside_starts"))
    of_file = Window.partitionBy("file").orderBy("block")
    crlf, other = F.first("ends").over(of_file).alias("crlf"), F.first("unlike").over(of_file).alias("other")
    return entered.select(*_BLOCK, "inside", _before(starts, *_BLOCK).alias("records"), crlf, other)


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, record, text): the records of each file, numbered from 1, with their line breaks."""
    return _records(spark, paths, ()).drop("other")


def _records(spark: SparkSession, paths: str | list[str], names: Sequence[str]) -> DataFrame:
    """As `records`, with `other`: whether the file's first line is a header of other columns."""
    placed = _placed(_lines(spark, paths))
    numbered = placed.join(_blocks(placed, names), [*_BLOCK], "left")
    begins = F.col("odd") == F.col("inside")  # an even number of quotes before it in the file
    in_block = Window.partitionBy(*_BLOCK).orderBy("line")
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    marked = numbered.withColumn("begins", begins).select(
        "file",
        "block",
        "line",
        "text",
        "begins",
        "crlf",
        "other",
        (F.col("records") + F.count_if("begins").over(upto)).alias("record"),
        F.lead("begins").over(in_block).alias("then"),
    )
    alone = F.col("begins") & F.coalesce("then", F.lit(False))
    whole = marked.filter(alone).select("file", "record", "text", "crlf", "other", F.lit(True).alias("closed"))
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "text")))
    joined = (
        marked.filter(~alone)
        .groupBy("file", "record")
        .agg(
            F.array_join(F.transform(parts, lambda part: part["text"]), "\n").alias("text"),
            F.max("crlf").alias("crlf"),
            F.max("other").alias("other"),
        )
        .withColumn("closed", F.length(F.replace("text", F.lit('"'), F.lit(""))) % 2 == F.length("text") % 2)
    )
    either = whole.union(joined)
    # Null where the blocks of the two passes differ, which must not pass silently.
    sound = F.col("record").isNotNull() & F.col("closed")
    checked = F.when(sound, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no end of a quoted field in "), "file")))
    # Breaks of a file whose lines end in two characters are read as one, in fields as well.
    ended = _unended(checked)
    one_break = F.replace(ended, F.lit("\r\n"), F.lit("\n"))
    return either.select("file", "record", F.when(F.col("crlf"), one_break).otherwise(ended).alias("text"), "other")


def read(spark: SparkSession, paths: str | list[str], schema: StructType, options: Mapping[str, object], name: str) -> DataFrame:
    """Typed rows of files that all begin with the columns of the schema.

    Rows of a file with another header do not parse either, and their tasks may be first; they name the header too.
    """
    found = _records(spark, paths, schema.names).filter("text <> ''")
    problem = F.concat(F.lit(f"Schema mismatch in {name}: another header in "), "file")
    # assert_true is null where it holds, so a sound header is left out.
    rows = found.filter(F.when(F.col("record") == 1, F.assert_true(_heads(F.col("text")) == _names(schema.names), problem).isNotNull()).otherwise(F.lit(True)))
    plain = {key: str(value) for key, value in options.items() if key not in ("header", "encoding")}
    ddl = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
    text = F.when(F.col("other"), F.raise_error(problem)).otherwise(F.col("text"))
    return rows.select(F.from_csv(text, ddl, plain | {"mode": "FAILFAST"}).alias("row")).select("row.*")
