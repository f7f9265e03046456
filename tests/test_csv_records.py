"""Multi-line CSV read in parallel, against the reader that takes a file as a whole."""

from __future__ import annotations

import pytest
from conftest import records

from pyspark.sql.types import IntegerType, StringType, StructType

from bazaarium.sources import csv_records, raw_csv

SCHEMA = StructType().add("id", IntegerType()).add("score", IntegerType()).add("said", StringType())
SAID = (
    "plain", '"with, comma"', '"two{n}lines"', '"a ""quoted"" word"', '""', "", '"{n}{n}x"', '"ends ""{n}"', '"a lone \r return"',
    '" spaces "', '"""{n}"""', '"{n}"', "漢é", '"x{n}{n}{n}{n}{n}{n}{n}{n}{n}{n}{n}{n}y ""{n}"""',
)


def write(path, ending, rows=300, end=""):
    lines = ['"id","score",said', *(f"{k},{k % 5},{SAID[k % len(SAID)].format(n=ending)}" for k in range(rows))]
    path.write_text(ending.join(lines) + ending + end, encoding="utf-8", newline="")
    return str(path)


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    for name, value in zip(names, ("150", "1"), strict=True):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def whole_files(spark, paths):
    options = raw_csv.CSV_OPTIONS | {"mode": "FAILFAST", "enforceSchema": False, "multiLine": True}
    return spark.read.options(**options).schema(SCHEMA).csv(paths)


@pytest.mark.parametrize("ending", ("\n", "\r\n"))
@pytest.mark.parametrize("end", ("", "\n\n"))
def test_equals_the_whole_file_reader(spark, small_blocks, tmp_path, ending, end):
    path = write(tmp_path / "said.csv", ending, end=end.replace("\n", ending))
    assert csv_records._lines(spark, path).rdd.getNumPartitions() > 20
    assert records(raw_csv.read_csv(spark, path, SCHEMA, "said", multiline=True)) == records(whole_files(spark, path))


def test_a_folder_of_files_with_different_breaks(spark, small_blocks, tmp_path):
    paths = [write(tmp_path / f"part-{i}.csv", ending, 40 + i) for i, ending in enumerate(("\n", "\r\n", "\n"))]
    found = raw_csv.read_csv(spark, str(tmp_path), SCHEMA, "said", multiline=True)
    assert records(found) == records(whole_files(spark, paths))


def test_what_is_not_sound_raises(spark, small_blocks, tmp_path):
    def read(text):
        (tmp_path / "odd.csv").write_text(text)
        return raw_csv.read_csv(spark, str(tmp_path / "odd.csv"), SCHEMA, "said", multiline=True).collect()

    assert read("id,score,said\n") == []
    with pytest.raises(Exception, match="no end of a quoted field"):
        read('id,score,said\n1,2,"open\n3,4,x\n')
    with pytest.raises(Exception, match="MALFORMED"):
        read('id,score,said\n1,two,"x\ny"\n')
    with pytest.raises(ValueError, match="missing columns"):
        read("id,said\n1,x\n")


def test_another_header_in_one_of_the_files_raises(spark, tmp_path):
    write(tmp_path / "a.csv", "\n")
    (tmp_path / "b.csv").write_text("id,said,score\n1,x,2\n")
    with pytest.raises(Exception, match="another header"):
        raw_csv.read_csv(spark, str(tmp_path), SCHEMA, "said", multiline=True).collect()


def test_only_records_of_several_lines_are_shuffled_again(spark, tmp_path):
    path = write(tmp_path / "said.csv", "\n")
    found = csv_records.records(spark, path)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # Lines by block, one row for each block by file, lines of longer records by record.
    assert plan.count("- Exchange hashpartitioning(file") == 3 and plan.count("FileScan") == 1
    assert "Python" not in plan and "CartesianProduct" not in plan
