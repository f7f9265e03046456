"""Small file-system helpers that work on any store Spark can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, sorted; empty if there are none."""
    path = _path(spark, pattern)
    found = _fs(spark, path).globStatus(path)
    return sorted(status.getPath().toString() for status in found or [])


def exists(spark: SparkSession, path: str) -> bool:
    target = _path(spark, path)
    return _fs(spark, target).exists(target)


def changed_at(spark: SparkSession, path: str) -> int:
    """When a file was last changed, in milliseconds."""
    target = _path(spark, path)
    return _fs(spark, target).getFileStatus(target).getModificationTime()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder or file, if it is there."""
    target = _path(spark, path)
    _fs(spark, target).delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name that driver and executors share, under the session's checkpoint folder.

    Without one, a folder of this machine serves a local session and no other.
    """
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small report file, replacing an earlier one."""
    target = _path(spark, path)
    stream = _fs(spark, target).create(target, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
