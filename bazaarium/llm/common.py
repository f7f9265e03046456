"""What the operators share: fresh column names, whole texts, stored tables, batches."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one numpy or Python step holds at a time.
CHUNK_BYTES = 2 << 20
#: Cells of the map that `with_any_of` broadcasts, 64 to a row; a power of two.
KEY_CELLS = 1 << 23


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """Names that no given column has, compared as Spark does, without case."""
    taken, names = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def column(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(name: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Just (doc_id long, text string), so that no other column can clash."""
    return docs.select(column(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where spark.checkpoint.dir is unset, as in local tests, a folder of this machine
    is made, once for an application; a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="bazaarium-shared-")
    return _LOCAL_FOLDERS[context.applicationId]


_LOCAL_FOLDERS: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def map_batches(rows: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """mapInArrow by position, which unlike the plain call takes any column name, dots and all."""
    plain = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))
    made = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return plain.mapInArrow(run, made).toDF(*schema.names)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Writes rows to the shared folder and reads them back.

    That fixes row order and partition numbers for later steps and cuts the lineage: a
    lost executor costs a reread, and no copy depends on one machine.
    """
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def with_any_of(rows: DataFrame, keys: Sequence[Column], wanted: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with a word of a map beside them, and whether their keys may be among the wanted ones.

    wanted: the keys alone, of the same types. One bit tells whether a hash cell has a wanted key, so a
    "no" is sure and a "yes" is to be confirmed by a join, to which only those rows need be
    shuffled. The map is of bounded size, whatever the number of keys; nulls are keys too.
    """
    word, bits = fresh(rows.columns, "word", "bits")

    def cell(names: Iterable[Column]) -> Column:
        return F.pmod(F.xxhash64(*names), F.lit(KEY_CELLS))

    found = wanted.select(cell(map(column, wanted.columns)).alias("cell")).groupBy(F.shiftright("cell", 6).alias(word))
    words = found.agg(F.expr("bit_or(shiftleft(1L, CAST(cell & 63 AS INT)))").alias(bits))
    marked = rows.join(F.broadcast(words), F.shiftright(cell(keys), 6) == column(word), "left")
    bit = F.call_function("shiftright", column(bits), cell(keys).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    return marked, F.coalesce(bit == 1, F.lit(False))


def bucketed(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, str]:
    """As `stored`, in buckets of the key: joins by it shuffle the other side only. Also names the table to drop.

    As many buckets as the session has shuffle partitions, else Spark would shuffle both
    sides; rows that were grouped by the key before lie in as many files.
    """
    path = new_path(rows.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    return rows.sparkSession.table(table), table


def content_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def read_ledger(spark: SparkSession, path: str, version: str, values: str) -> DataFrame | None:
    """(digest, values) of one version, one row for each digest; None before anything was written.

    Two runs may have appended the same digest at the same time. Values are a function
    of digest and version, so either row will do.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.schema(f"digest binary, version string, {values}").parquet(path).filter(F.col("version") == version)
    names = [n for n in rows.columns if n not in ("digest", "version")]
    return rows.groupBy("digest").agg(*(F.max(n).alias(n) for n in names))


def complete_ledger(texts: DataFrame, path: str, version: str, values: str, work: Callable) -> DataFrame:
    """Does the work for each distinct text that the ledger lacks, appends it, and reads the ledger.

    texts: (digest, text), one row for each document. Copies are dropped before the
    shuffle, so a text that many documents hold is no hot key. work maps Arrow batches
    of (digest, text) to batches of (digest, version, values). Their rows are small beside
    the texts, so they are gathered into files of the usual size before they are appended;
    else each task that holds texts would write a file of its own. What is returned is
    stored with one row for each digest, so a join to it has two plain shuffles for sides
    and Spark splits the documents of a hot digest.
    """
    spark = texts.sparkSession
    missing = texts.select("digest", "text").dropDuplicates(["digest"])
    known = read_ledger(spark, path, version, values)
    if known is not None:
        missing = missing.join(known, "digest", "left_anti")
    schema = f"digest binary, version string, {values}"
    missing.mapInArrow(work, schema).hint("rebalance", "digest").write.mode("append").parquet(path)
    return stored(read_ledger(spark, path, version, values), "ledger")


def ship_package(spark: SparkSession) -> None:
    """Lets workers import this package where nobody passed it with --py-files; once per application.

    Shipped as a module, not by value, so that what a worker has learnt outlives a task.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="bazaarium-package-")) / "bazaarium.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted((root / "bazaarium").rglob("*.py")):
            packed.write(source, source.relative_to(root))
    context.addPyFile(str(archive))


_SHIPPED: set[str] = set()


def chunks(batches: Iterable[pa.RecordBatch], text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of each slice stay under the limit, or it is one row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)
