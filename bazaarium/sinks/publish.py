"""A run of the job becomes visible as a whole, after all its gates, or not at all.

Every run writes to a folder of its own under `OUT/runs`. Publishing creates one small
file under `OUT/published` whose name is the run's; nothing is overwritten, so readers
of the former run are not disturbed. The latest published run is the current one.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from bazaarium.sources import files


def new_run(out: str) -> str:
    """The folder of a new run. Names sort by the time at which runs began."""
    started = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    return f"{out.rstrip('/')}/runs/{started}-{uuid.uuid4().hex[:8]}"


def publish(spark: SparkSession, run: str) -> None:
    out, name = run.split("/runs/")
    files.write_text(spark, f"{out}/published/{name}", f"{run}\n")


def current(spark: SparkSession, out: str) -> str | None:
    """The folder of the latest published run, or None before the first."""
    out = out.rstrip("/")
    published = files.matching(spark, f"{out}/published/*")
    return f"{out}/runs/{published[-1].rsplit('/', 1)[1]}" if published else None
