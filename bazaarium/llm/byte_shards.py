"""Contiguous shards of equal size from global prefix sums (operator 7).

Rows are put in one global order by range partitioning and stored in that order. Each
partition then has a total, the totals have a prefix sum, and a row's place on the byte
line is its partition's start plus the running sum inside the partition. Shard k of n
takes the rows whose middle lies in the k-th of n equal stretches of that line, so every
shard is within one row of the target on either side.

Order: the given columns, nulls first, then size; rows equal in all of them are in any
order, fixed once the table is stored. A null text has no bytes; a text of
any length is one row, and its shard may be that much larger. Other columns, whatever their
names, are kept by `assign_shards` and ignored by `shard_documents`. An empty table gives an
empty result; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bazaarium.llm.common import column, fresh, map_batches, stored


def _running(size_at: int, width: int):
    """Appends partition number, rank and bytes before each row, all within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(size_at)
            ends = pc.add(pc.cumulative_sum(sizes), total)
            more = [
                pa.array([part] * batch.num_rows, pa.int64()),
                pa.array(range(rows, rows + batch.num_rows), pa.int64()),
                pc.subtract(ends, sizes),
            ]
            rows, total = rows + batch.num_rows, ends[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *more], [str(i) for i in range(width + 3)])

    return run


def assign_shards(rows: DataFrame, size_column: str, order: Sequence[str], shards: int) -> DataFrame:
    """All columns and rows, with `shard` from 0 and `slot`, the place in the shard from 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    part, rank, start, base_rows, base_bytes, total, first, tie = fresh(
        [*rows.columns, "shard", "slot"], "part", "rank", "start", "base_rows", "base_bytes", "total", "first", "tie"
    )
    shard, slot = fresh(rows.columns, "shard", "slot")
    # Rows that agree in the whole order could all fall into one range; the last column parts them.
    keys = [*map(column, order), column(size_column), column(tie)]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    longs = [T.StructField(name, T.LongType()) for name in (part, rank, start)]
    schema = T.StructType([*rows.schema.fields, *longs])
    laid = stored(map_batches(dealt, _running(rows.columns.index(size_column), len(rows.columns)), schema), "shard-order")

    # One row for each partition: the only place where all partitions meet.
    totals = laid.groupBy(part).agg(F.count("*").alias(base_rows), F.sum(column(size_column)).alias(base_bytes))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        part,
        F.coalesce(F.sum(base_rows).over(before), F.lit(0)).alias(base_rows),
        F.coalesce(F.sum(base_bytes).over(before), F.lit(0)).alias(base_bytes),
        F.sum(base_bytes).over(every).alias(total),
    )
    placed = laid.join(F.broadcast(starts), part)  # as many rows as the table has partitions
    twice_middle = (column(base_bytes) + column(start)) * 2 + column(size_column)
    at = F.floor((twice_middle.cast("decimal(38,0)") * shards) / (column(total) * 2).cast("decimal(38,0)"))
    placed = placed.withColumn(shard, F.least(at.cast("int"), F.lit(shards - 1))).withColumn(rank, column(rank) + column(base_rows))
    firsts = placed.groupBy(shard).agg(F.min(rank).alias(first))
    found = placed.join(F.broadcast(firsts), shard)  # one row for each shard
    return found.select(*map(column, rows.columns), column(shard), (column(rank) - column(first)).alias(slot))


def shard_documents(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): the plan alone, without carrying texts."""
    text = column(text_column).cast("string")
    rows = docs.select(
        column(id_column).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return assign_shards(rows, "size", ["doc_id", "text_crc32"], shards)


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Whole rows as Parquet under path/shard=k, with their size and slot."""
    (size,) = fresh(docs.columns, "size")
    text = column(text_column).cast("string")
    rows = docs.withColumn(size, (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"))
    placed = assign_shards(rows, size, [id_column], shards)
    placed.write.partitionBy(placed.columns[-2]).parquet(path)
