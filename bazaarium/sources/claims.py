"""Manifest loads that skip what they have loaded, copy several files at once and keep rejects.

Every loaded file is claimed by a digest of its content. A later run, or a run that goes
on after one that was cut off, copies only files whose content is new or whose table is
not there; the others are audited as `skipped`. A claim is written after its table, so a
run that dies in between copies that file again and no claim is ever ahead of its table.

Files of one `load_order` are copied at the same time, up to a bound; the next order waits
for them. A line that does not fit the declared types is not loaded and does not fail its
file: it goes to the rejects with its file and the reason. Records of several lines have
no such line, so the tables in `MULTILINE_SOURCES` fail as a whole, as they do in
`manifest.load_manifest`. Audit, claims and rejects are written by the calling thread
alone, because two appends to one folder at a time would remove each other's files.

The digest adds up 60 bits of the MD5 of each line and counts the lines; it is made by a
distributed job. It does not depend on the order of lines, which has no meaning for a
table; where records have several lines, the time of the file's last change is part of it.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bazaarium import contracts
from bazaarium.sources import files, manifest
from bazaarium.sources.raw_csv import CSV_OPTIONS, header

CLAIMS = "source_file string, target string, digest string, run_id string, claimed_at timestamp_ntz"
REJECTS = "run_id string, source_file string, line string, reason string"
_BAD = "_rejected_line"


@dataclass
class _Outcome:
    """What became of one file; `rejected` is a frame of (line, reason)."""

    digest: str | None = None
    read: int | None = None
    written: int | None = None
    status: str = "failed"
    error: str | None = None
    rejected: DataFrame | None = None


def content_digest(spark: SparkSession, path: str, with_time: bool = False) -> str:
    lines = spark.read.text(path)
    number = F.conv(F.substring(F.md5(F.col("value").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    found = lines.agg(F.count("*").alias("n"), F.coalesce(F.sum(number), F.lit(0)).alias("s")).first()
    return f"{found['n']}:{found['s']}" + (f":{files.changed_at(spark, path)}" if with_time else "")


def _reason(typed: StructType) -> Column:
    """Why a line does not fit: fields that have a text but no value, or their number."""
    texts = StructType([StructField(f.name, StringType()) for f in typed])
    options = {"quote": CSV_OPTIONS["quote"], "escape": CSV_OPTIONS["escape"]}
    told = F.from_csv(F.col(_BAD), texts.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    wrong = [
        F.when(told.getField(f.name).isNotNull() & F.col(f"`{f.name}`").isNull(), F.lit(f.name)) for f in typed
    ]
    named = F.concat_ws(", ", *wrong)
    return F.when(named != "", F.concat(F.lit("does not fit: "), named)).otherwise("wrong number of fields")


def _copy(spark: SparkSession, source: str, target: str, table: str) -> tuple[int, int, int, DataFrame | None]:
    """Copy one file; return the lines read, the rows found in the table, the number of
    rejected lines, and these."""
    if table in contracts.MULTILINE_SOURCES:
        return *manifest._copy(spark, source, target, table), 0, None
    present, ddl = header(spark, source), contracts.SOURCES.get(table)
    declared = {f.name: f for f in contracts.struct(ddl)} if ddl else {}
    missing = [name for name in declared if name not in present]
    if missing:
        raise ValueError(f"Schema mismatch in {table}: missing columns {missing}")
    typed = StructType([declared.get(name, StructField(name, StringType())) for name in present])
    lines = (
        spark.read.options(**CSV_OPTIONS)
        .schema(StructType([*typed.fields, StructField(_BAD, StringType())]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD)
        .csv(source)
    )
    seen = Observation()
    watched = lines.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(_BAD).alias("bad"))
    watched.filter(F.col(_BAD).isNull()).drop(_BAD).write.mode("overwrite").parquet(target)
    bad = lines.filter(F.col(_BAD).isNotNull()).select(F.col(_BAD).alias("line"), _reason(typed).alias("reason"))
    refused = seen.get["bad"]
    return seen.get["rows"], spark.read.parquet(target).count(), refused, bad if refused else None


def _load(spark: SparkSession, source: str, target: str, table: str, claimed: str | None) -> _Outcome:
    done = _Outcome()
    try:
        if not files.exists(spark, source):
            raise FileNotFoundError(f"required file is missing: {source}")
        done.digest = content_digest(spark, source, table in contracts.MULTILINE_SOURCES)
        if done.digest == claimed and files.exists(spark, f"{target}/_SUCCESS"):
            done.status = "skipped"
            return done
        done.read, done.written, refused, done.rejected = _copy(spark, source, target, table)
        if done.read != done.written + refused:
            raise ValueError(f"{done.read} rows read but {done.written} written and {refused} rejected")
        done.status = "succeeded"
    except Exception as problem:  # audited, and raised when the other files are done
        done.status, done.error = "failed", f"{type(problem).__name__}: {problem}"
    return done


def _append(spark: SparkSession, row: tuple, ddl: str, path: str) -> None:
    spark.createDataFrame([row], contracts.struct(ddl)).coalesce(1).write.mode("append").parquet(path)


def _claimed(spark: SparkSession, path: str) -> dict[tuple[str, str], str]:
    """The latest claim of each file and target: as many as manifests ever listed."""
    if not files.exists(spark, path):
        return {}
    claims = spark.read.schema(contracts.struct(CLAIMS)).parquet(path)
    latest = claims.groupBy("source_file", "target").agg(F.max_by("digest", "claimed_at").alias("digest"))
    return {(row["source_file"], row["target"]): row["digest"] for row in latest.collect()}


def load_unseen(
    spark: SparkSession,
    listed: DataFrame,
    source_folder: str,
    target_root: str,
    log_root: str,
    at_once: int = 4,
    run_id: str | None = None,
) -> str:
    """Load the enabled rows of a manifest whose files are not loaded yet; return the run's id.

    `log_root` holds `audit`, `claims` and `rejects`. Raises when all files were tried, if
    one of them was missing or failed.
    """
    run_id, log_root = run_id or str(uuid.uuid4()), log_root.rstrip("/")
    claimed, failed = _claimed(spark, f"{log_root}/claims"), []
    entries = listed.filter("enabled = 1").orderBy("load_order", "source_file").collect()
    targets = [f"{target_root.rstrip('/')}/{e['target_schema']}/{e['target_table']}" for e in entries]
    if len(set(targets)) < len(targets):
        raise ValueError("two files of the manifest have one target")

    def begin(entry: Row, target: str) -> tuple:
        started, source = manifest._now(), f"{source_folder.rstrip('/')}/{entry['source_file']}"
        known = claimed.get((entry["source_file"], target))
        return entry, target, started, _load(spark, source, target, entry["target_table"], known)

    with ThreadPoolExecutor(max(at_once, 1)) as pool:
        for _, same in groupby(zip(entries, targets), key=lambda pair: pair[0]["load_order"]):
            for copied in as_completed([pool.submit(begin, *pair) for pair in same]):
                entry, target, started, done = copied.result()
                name = entry["source_file"]
                if done.status == "succeeded" and done.rejected is not None:
                    told = done.rejected.select(F.lit(run_id).alias("run_id"), F.lit(name).alias("source_file"), "line", "reason")
                    told.write.mode("append").parquet(f"{log_root}/rejects")
                row = (run_id, name, started, manifest._now(), done.read, done.written, done.status, done.error)
                _append(spark, row, contracts.AUDIT, f"{log_root}/audit")
                if done.status == "succeeded":
                    _append(spark, (name, target, done.digest, run_id, manifest._now()), CLAIMS, f"{log_root}/claims")
                elif done.status == "failed":
                    failed.append(name)
    if failed:
        raise RuntimeError(f"Manifest load {run_id} failed for {sorted(failed)}; see {log_root}/audit")
    return run_id


def rejects(spark: SparkSession, log_root: str) -> DataFrame:
    """All rejected lines so far, with run, file and reason; empty if there are none."""
    path, schema = f"{log_root.rstrip('/')}/rejects", contracts.struct(REJECTS)
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
