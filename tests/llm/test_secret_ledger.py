from __future__ import annotations

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from bazaarium.llm import queries, secret_ledger
from bazaarium.llm.common import new_path, stored

from .conftest import rows

KEY, HEX = "AKIA" + "Q7" * 8, "0123456789abcdef" * 2


def base(text: str) -> list[tuple[int, int, int, str]]:
    found = []
    pattern = r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for m in re.finditer(pattern, text):
        if len(m[1]) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_spans_are_leftmost_in_code_points_and_short_ones_drop():
    compiled = secret_ledger._compiled(secret_ledger.RULES)
    text = f"é漢 PassWord : 'hunter2hunter2' {KEY} token=short api_key=\"{HEX}\" ſecret=abcdefghij"
    found = secret_ledger.find_spans(text, compiled)
    assert [(s, e, k) for k, s, e in found] == [(s, e, k) for s, _, e, k in base(text)]
    assert [k for k, _, _ in found] == ["assign", "access", "assign", "hex"]


def test_the_method_adds_spans_and_redaction_takes_all():
    compiled = secret_ledger._compiled(secret_ledger.RULES)
    text = "see ghp_" + "a1B2" * 9 + " and -----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY-----."
    spans = secret_ledger.find_spans(text, compiled)
    assert [k for k, _, _ in spans] == ["forge", "pem"]
    assert secret_ledger.redacted(text, secret_ledger.joined(spans)) == "see [forge] and [pem]."


def test_tokens_of_three_parts_are_found_in_linear_time():
    compiled = secret_ledger._compiled(secret_ledger.RULES)
    slow = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice([".", ".", "eyJ", "eyJabcdefgh", "x" * 9, "ab-_", " "]) for _ in range(rng.randrange(25)))
        found = [(s, e) for k, s, e in secret_ledger.find_spans(text, compiled) if k == "jwt"]
        assert found == [m.span() for m in slow.finditer(text)], text
    for long in ("eyJ" * 400_000 + ".eyJ", ("eyJ" * 5 + ".") * 80_000, "a://:" * 200_000, "a://b:c" * 150_000, "x" * 1_000_000 + "://"):
        began = time.process_time()
        secret_ledger.find_spans(long, compiled)
        assert time.process_time() - began < 4


def test_credentials_in_addresses_have_any_length():
    compiled = secret_ledger._compiled(secret_ledger.RULES)
    for text in ("redis://:pw@host", "https://me:x@host", "ftp://u:" + "y" * 500 + "@host"):
        assert [k for k, _, _ in secret_ledger.find_spans(text, compiled) if k == "url"] == ["url"], text


def test_rows_of_a_hot_text_lie_in_several_partitions(spark, docs):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {name: spark.conf.get(name) for name in settings}
    spread = spark.range(30_000).repartition(6).selectExpr("id AS doc_id", f"IF(id % 3 = 0, 'token={HEX}', CONCAT('t', id)) AS text")
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found = secret_ledger.scan(spread).withColumn("at", F.spark_partition_id())
        hot = stored(found, "placed").filter("spans <> ''").groupBy("at").count().collect()
        assert sum(r["count"] for r in hot) == 10_000 and len(hot) > 1
        secret_ledger.BROADCAST_BYTES, limit = -1, secret_ledger.BROADCAST_BYTES
        try:
            clean = stored(secret_ledger.redact(spread).withColumn("at", F.spark_partition_id()), "placed")
        finally:
            secret_ledger.BROADCAST_BYTES = limit
        assert clean.filter("text = '[assign]'").groupBy("at").count().count() > 1
        assert clean.filter("text = '[assign]'").count() == 10_000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_overlapping_spans_are_replaced_once():
    text = f"secret={HEX} end"
    spans = secret_ledger.joined(secret_ledger.find_spans(text, secret_ledger._compiled(secret_ledger.RULES)))
    assert spans.startswith("assign:0:") and ",hex:7:" in spans
    assert secret_ledger.redacted(text, spans) == "[assign] end"


def test_only_unseen_blobs_and_rule_versions_are_scanned(spark, docs):
    path = new_path(spark, "ledger")
    first = docs((1, f"x {KEY}"), (2, f"x {KEY}"), (3, "clean"))
    assert rows(secret_ledger.scan(first, path), "doc_id", "spans") == [(1, "access:2:22"), (2, "access:2:22"), (3, "")]
    assert spark.read.parquet(path).count() == 2
    rows(secret_ledger.scan(docs((4, "clean"), (5, "other")), path))
    assert spark.read.parquet(path).count() == 3
    rows(secret_ledger.scan(first, path, secret_ledger.BASE))
    assert spark.read.parquet(path).groupBy("version").count().count() == 2


def test_edges(docs):
    table = docs((None, None), (1, ""), (2, f"token={HEX}"), (2, f"token={HEX}"), (3, "a" * 200_000))
    found = rows(secret_ledger.scan(table), "doc_id", "spans")
    long = "hex:0:200000"
    assert found == sorted([(None, ""), (1, ""), (2, "assign:0:38,hex:6:38"), (2, "assign:0:38,hex:6:38"), (3, long)], key=repr)
    clean = secret_ledger.redact(table)
    assert clean.columns == table.columns
    assert rows(clean, "doc_id", "text") == sorted([(None, None), (1, ""), (2, "[assign]"), (2, "[assign]"), (3, "[hex]")], key=repr)
    assert rows(secret_ledger.scan(table.limit(0))) == [] == rows(secret_ledger.redact(table.limit(0)))


def test_the_query_holds_for_every_document(spark, small_folder):
    small_folder = small_folder.replace("sf0.001", "sf0.01")  # the smallest tables hold no secret
    found = {r["doc_id"]: r for r in queries.op4_secret_ledger(spark, small_folder).collect()}
    seen = 0
    for row in queries.documents(spark, small_folder).collect():
        spans, held = base(row["text"] or ""), found.pop(row["doc_id"])
        seen += len(spans)
        counts = [sum(k == kind for *_, k in spans) for kind in ("assign", "access", "hex")]
        assert [held["n_assign"], held["n_access"], held["n_hex"]] == counts
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        assert held["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(held["spans"].split(","))
    assert seen and not found
