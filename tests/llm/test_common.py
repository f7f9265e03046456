from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bazaarium.llm import common

from .conftest import rows


class Session:
    """A session without a shared folder."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app of {master}"})()


def test_a_local_session_gets_one_folder_and_a_cluster_must_name_its_own():
    own = common.shared_folder(Session("local[2]"))
    assert own.startswith("file://") and common.shared_folder(Session("local[2]")) == own
    for master in ("spark://host:7077", "local-cluster[3,2,1000]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(Session(master))
    named = Session("yarn")
    named.conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert common.shared_folder(named) == "hdfs:///shared"


def test_rows_of_wanted_keys_are_never_missed(docs, monkeypatch):
    table = [(i % 40 or None, f"t{i % 7}" if i % 11 else None) for i in range(120)]
    given = docs(*table).withColumnRenamed("size", "word").withColumnRenamed("class", "bits")
    keys = [F.col("doc_id"), F.col("text")]
    wanted = [(None, "t1"), (3, None), (12, "t5"), (None, None), (3, None)]
    among = given.sparkSession.createDataFrame(wanted, "k long, `k.t` string")
    for cells in (common.KEY_CELLS, 64):
        monkeypatch.setattr(common, "KEY_CELLS", cells)
        marked, perhaps = common.with_any_of(given, keys, among)
        found = rows(marked.select("doc_id", "text", perhaps.alias("perhaps")))
        assert sorted(((a, b) for a, b, _ in found), key=repr) == sorted(table, key=repr)
        hit = [(a, b) for a, b, sure in found if sure]
        missed = [(a, b) for a, b, sure in found if not sure]
        assert not set(missed) & set(wanted) and set(hit) >= set(wanted) & set(table)
        assert None not in {sure for _, _, sure in found}
        if cells > 64:
            assert set(hit) == set(wanted) & set(table)
    assert rows(common.with_any_of(given, keys, among.limit(0))[0].select("doc_id", "text")) == sorted(table, key=repr)
