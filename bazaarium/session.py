"""Session settings the jobs are written for.

Nothing in the library depends on these for right results; they only steer the
physical plan. Master, memory and executor counts belong to the cluster, and so does
the number of shuffle partitions, unless the size of the input asks for more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Aim for shuffle partitions of about this size before AQE merges or splits them.
TARGET_PARTITION_BYTES = 192 * 1024 * 1024

# Stored bytes that make a task's worth of rows. Compressed columns grow about tenfold in
# sorts and joins, and a task may hold several of them side by side.
TASK_BYTES = 8 * 1024 * 1024
# The same for shuffled bytes, where AQE merges partitions.
SHUFFLED_TASK_BYTES = 16 * 1024 * 1024

PARTITIONS = "spark.sql.shuffle.partitions"
_MERGED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
# Sizes from here on mean that the optimizer does not know.
_UNKNOWN_BYTES = 1 << 60


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Joins with a hot key on a scanned side are split at run time; hot keys
        # that AQE cannot see are salted in operators/skew.py.
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        # Recording the Python call site of every column costs more than planning.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder


@contextmanager
def set_for(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Settings of the session for the queries that run inside, and the former ones afterwards."""
    former = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in former.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def planned_bytes(frames: Iterable[DataFrame]) -> int:
    """What the optimizer expects the frames to hold, from file sizes; no job runs."""
    sizes = [int(f._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for f in frames]
    return sum(size for size in sizes if size < _UNKNOWN_BYTES)


def scanned_bytes(rows: DataFrame) -> int:
    """Size of what a plan reads. Unlike the size expected of its result, which multiplies
    the sides of a join, it does not run away."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(size for size in sizes if size < _UNKNOWN_BYTES)


def fit_partitions(spark: SparkSession, shuffled_bytes: int) -> int:
    """Raise the session's shuffle partitions to the size of the input; never lower them."""
    partitions = max(int(spark.conf.get(PARTITIONS)), -(-shuffled_bytes // TARGET_PARTITION_BYTES))
    spark.conf.set(PARTITIONS, str(partitions))
    return partitions


def fit_tasks(spark: SparkSession, stored_bytes: int) -> int:
    """Enough shuffle partitions that a task's rows stay in memory whatever the size of the input.

    Never fewer than submitted. AQE merges small ones, up to a size that is set only where
    the session leaves it open.
    """
    partitions = max(int(spark.conf.get(PARTITIONS)), -(-stored_bytes // TASK_BYTES))
    spark.conf.set(PARTITIONS, str(partitions))
    if spark.conf.get(_MERGED, None) is None:
        spark.conf.set(_MERGED, str(SHUFFLED_TASK_BYTES))
    return partitions
