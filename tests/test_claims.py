"""Manifest loads by content: reruns, half-finished runs, rejected lines."""

from __future__ import annotations

import os

import pytest
from conftest import records
from test_files import FILE_NAMES, write_delivery

from bazaarium import contracts
from bazaarium.sources import claims

LISTED = ("orders", "customers", "order_payments", "order_reviews")


def listed(spark, names=LISTED):
    rows = [(FILE_NAMES[name], "stg", name, 1 + number // 3, 1) for number, name in enumerate(names)]
    return spark.createDataFrame(rows, contracts.struct(contracts.MANIFEST))


def statuses(spark, root, run) -> dict[str, tuple]:
    rows = spark.read.parquet(f"{root}/audit").filter(f"run_id = '{run}'").collect()
    return {r.source_file: (r.status, r.source_rows, r.written_rows) for r in rows}


def test_reruns_copy_only_what_is_new_and_keep_rejects(spark, mixed_orders, tmp_path):
    raw, lake, log = (str(tmp_path / name) for name in ("raw", "lake", "log"))
    write_delivery(mixed_orders, tmp_path / "raw")
    payments = tmp_path / "raw" / FILE_NAMES["order_payments"]
    with payments.open("a") as handle:
        handle.write("slow,2,voucher,many,7.50\nslow,3\n")
    first = claims.load_unseen(spark, listed(spark), raw, lake, log)
    found = statuses(spark, log, first)
    assert set(found) == {FILE_NAMES[name] for name in LISTED}
    assert found[FILE_NAMES["orders"]] == ("succeeded", 3, 3)
    status, read, written = found[FILE_NAMES["order_payments"]]
    assert (status, read - written) == ("succeeded", 2) and written == 5
    assert spark.read.parquet(f"{lake}/stg/order_payments").count() == 5
    assert records(claims.rejects(spark, log), "source_file", "line", "reason") == [
        (payments.name, "slow,2,voucher,many,7.50", "does not fit: payment_installments"),
        (payments.name, "slow,3", "wrong number of fields"),
    ]

    stamp = os.stat(tmp_path / "lake" / "stg" / "orders" / "_SUCCESS").st_mtime_ns
    with (tmp_path / "raw" / FILE_NAMES["customers"]).open("a") as handle:
        handle.write("c-new,dora,50030,recife,PE\n")
    second = statuses(spark, log, claims.load_unseen(spark, listed(spark), raw, lake, log))
    customers = second.pop(FILE_NAMES["customers"])
    assert customers == ("succeeded", 4, 4) and set(second.values()) == {("skipped", None, None)}
    assert os.stat(tmp_path / "lake" / "stg" / "orders" / "_SUCCESS").st_mtime_ns == stamp
    assert claims.rejects(spark, log).count() == 2


def test_a_half_finished_run_is_gone_on_with(spark, mixed_orders, tmp_path, monkeypatch):
    raw, lake, log = (str(tmp_path / name) for name in ("raw", "lake", "log"))
    write_delivery(mixed_orders, tmp_path / "raw")
    append, names = claims._append, ("orders", "customers")

    def killed(spark, row, ddl, path):
        if ddl == claims.CLAIMS and row[0] == FILE_NAMES["customers"]:
            raise KeyboardInterrupt
        append(spark, row, ddl, path)

    monkeypatch.setattr(claims, "_append", killed)
    with pytest.raises(KeyboardInterrupt):
        claims.load_unseen(spark, listed(spark, names), raw, lake, log, at_once=1)
    monkeypatch.setattr(claims, "_append", append)
    found = statuses(spark, log, claims.load_unseen(spark, listed(spark, names), raw, lake, log))
    assert found[FILE_NAMES["customers"]] == ("succeeded", 3, 3)  # its table was there, its claim was not
    assert found[FILE_NAMES["orders"]][0] in ("skipped", "succeeded")

    (tmp_path / "raw" / FILE_NAMES["orders"]).unlink()
    with pytest.raises(RuntimeError, match="orders"):
        claims.load_unseen(spark, listed(spark, names), raw, lake, log, run_id="missing")
    assert statuses(spark, log, "missing")[FILE_NAMES["orders"]] == ("failed", None, None)
    assert statuses(spark, log, "missing")[FILE_NAMES["customers"]][0] == "skipped"


def test_two_files_for_one_table_are_refused(spark):
    rows = [("a.csv", "stg", "t", 1, 1), ("b.csv", "stg", "t", 2, 1)]
    plan = spark.createDataFrame(rows, contracts.struct(contracts.MANIFEST))
    with pytest.raises(ValueError, match="one target"):
        claims.load_unseen(spark, plan, "/nowhere", "/nowhere", "/nowhere")
