from __future__ import annotations

import zlib

from bazaarium.llm import byte_shards, queries
from bazaarium.llm.common import new_path

from .conftest import rows


def expected(table: list[tuple], shards: int) -> list[tuple]:
    sized = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in table]
    sized.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, start, slots, out = sum(s for _, s, _ in sized), 0, [0] * shards, []
    for doc_id, size, crc in sized:
        shard = min(shards - 1, (2 * start + size) * shards // (2 * total))
        out.append((doc_id, size, crc, shard, slots[shard]))
        slots[shard] += 1
        start += size
    return sorted(out, key=repr)


def test_shards_are_contiguous_balanced_and_gapless(docs):
    table = [(i * 7 % 501, "x" * (i % 13)) for i in range(500)] + [(None, None), (None, "é"), (3, "y"), (3, "y"), (3, "y")]
    found = rows(byte_shards.shard_documents(docs(*table).repartition(7), 16))
    assert found == expected(table, 16)
    sizes = [sum(r[1] for r in found if r[3] == k) for k in range(16)]
    assert max(sizes) - min(sizes) <= 2 * 13


def test_edges(docs):
    assert rows(byte_shards.shard_documents(docs((1, "a")).limit(0))) == []
    few = [(1, ""), (2, "z" * 100_000), (3, None)]
    assert rows(byte_shards.shard_documents(docs(*few), 4)) == expected(few, 4)
    same = [(1, "a")] * 64  # nothing tells these rows apart
    assert [sum(r[3] == k for r in rows(byte_shards.shard_documents(docs(*same), 16))) for k in range(16)] == [4] * 16


def test_whole_rows_are_written_by_shard(spark, docs):
    table, path = docs((2, "bb"), (1, "a"), (3, None)), new_path(spark, "shards")
    byte_shards.write_shards(table, path, 2)
    back = spark.read.parquet(path)
    assert set(table.columns) < set(back.columns) and back.count() == 3
    assert [r["shard"] for r in back.orderBy("doc_id").collect()] == [0, 1, 1]


def test_the_query_holds_for_every_document(spark, small_folder):
    table = [(r["doc_id"], r["text"]) for r in queries.documents(spark, small_folder).collect()]
    found = queries.op7_byte_shards(spark, small_folder)
    assert rows(found, "doc_id", "size", "text_crc32", "shard", "slot") == expected(table, 16)
    assert rows(found.select("law", "grown_shard").distinct()) == [("bytes", None)]
