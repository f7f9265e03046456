"""Manifest-driven staging: copy every enabled file to its table, with an audit row."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bazaarium import contracts
from bazaarium.sources import files
from bazaarium.sources.raw_csv import header, read_csv


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, contracts.struct(contracts.MANIFEST), "manifest")


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _copy(spark: SparkSession, source: str, target: str, table: str) -> tuple[int, int]:
    """Copy one file; return the rows read and the rows found in the new table."""
    ddl = contracts.SOURCES.get(table)
    names = header(spark, source)
    schema = contracts.struct(ddl) if ddl else contracts.struct(", ".join(f"`{c}` string" for c in names))
    seen = Observation()
    rows = read_csv(
        spark, source, schema, table, multiline=table in contracts.MULTILINE_SOURCES
    ).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").parquet(target)
    return seen.get["rows"], spark.read.parquet(target).count()


def load_manifest(
    spark: SparkSession,
    manifest: DataFrame,
    source_folder: str,
    target_root: str,
    audit_path: str,
    run_id: str | None = None,
) -> str:
    """Load the enabled manifest rows in `load_order`; append one audit row per file.

    The row is written as soon as its file is done, so a run that is killed leaves the
    audit of what it did.

    Reruns replace the target tables. A missing file, a failed copy or differing
    row counts are audited and make the run fail after the remaining files.
    The manifest is a short list of files, so it is planned on the driver; each
    copy is one distributed job.
    """
    run_id = run_id or str(uuid.uuid4())
    failed = []
    for entry in manifest.filter("enabled = 1").orderBy("load_order").collect():
        source = f"{source_folder.rstrip('/')}/{entry['source_file']}"
        target = f"{target_root.rstrip('/')}/{entry['target_schema']}/{entry['target_table']}"
        started, read, written, error = _now(), None, None, None
        try:
            if not files.exists(spark, source):
                raise FileNotFoundError(f"required file is missing: {source}")
            read, written = _copy(spark, source, target, entry["target_table"])
            if read != written:
                raise ValueError(f"{read} rows read but {written} rows written")
        except Exception as problem:  # audited here, raised below
            error = f"{type(problem).__name__}: {problem}"
            failed.append(entry["source_file"])
        status = "failed" if error else "succeeded"
        row = (run_id, entry["source_file"], started, _now(), read, written, status, error)
        audit = spark.createDataFrame([row], contracts.struct(contracts.AUDIT))
        audit.coalesce(1).write.mode("append").parquet(audit_path)
    if failed:
        raise RuntimeError(f"Manifest load {run_id} failed for {failed}; see {audit_path}")
    return run_id
