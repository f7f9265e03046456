"""Exact deduplication with owners held in Patricia tries (operator 3).

Every text becomes a key: its byte length, its 64-bit content hash and then all its
bytes. Each input partition first inserts its own keys into a trie, so that copies meet
before the shuffle and a text that a third of all rows hold reaches the network once per
partition. The survivors are dealt by (length, hash), sorted by it, and inserted again;
a terminal node holds the smallest identifier of its text, and the number of its rows.

Memory is bounded by spilling subtrees. Before the shuffle, a trie over its budget
hands all its terminals on as partial rows, which the second trie merges. After the
shuffle keys arrive in the order of their first 16 bytes, so a subtree below a smaller
prefix is complete: over the budget, those subtrees leave as results and are freed. No
file is written on a worker.

Identifiers are compared as integers; `keep="largest"` turns their order round. A null
identifier is last in either order. Null texts count as empty. Repeated rows are copies
like any other and exactly one row of each text is kept. An empty table gives an empty
result, and columns of any name may ride along.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarium.llm.common import column, fresh, id_and_text, map_batches, whole_text

#: Bytes of labels that one trie may hold.
TRIE_BYTES = 48 << 20
#: What a node costs besides its label.
_NODE_BYTES = 300
_PREFIX = 16


class _Node:
    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.children, self.value = label, {}, value


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of label and key[at:]; they are known to differ within label."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


class RadixTrie:
    """A compressed radix trie over byte strings. Terminal nodes hold a value each."""

    def __init__(self):
        self.root, self.bytes, self.nodes = _Node(b""), 0, 0

    @property
    def held(self) -> int:
        return self.bytes + _NODE_BYTES * self.nodes

    def insert(self, key: bytes, value, merge) -> None:
        """Adds a key; merge(old, new) decides what a terminal that is already there holds."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], value)
                self.bytes, self.nodes = self.bytes + len(key) - at, self.nodes + 1
                return
            if not key.startswith(child.label, at):
                shared = _common(child.label, key, at)
                upper = _Node(child.label[:shared])
                child.label = child.label[shared:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                self.nodes += 1
                child = upper
            node, at = child, at + len(child.label)
        node.value = value if node.value is None else merge(node.value, value)

    def terminals(self) -> Iterator[tuple[bytes, object]]:
        """Keys in byte order, with their values."""
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            prefix += node.label
            if node.value is not None:
                yield prefix, node.value
            for first in sorted(node.children, reverse=True):
                stack.append((prefix, node.children[first]))

    def take_below(self, bound: bytes) -> list[tuple[bytes, object]]:
        """Removes and returns the terminals whose key is smaller than a bound, subtree by subtree."""
        below, rest = [], RadixTrie()
        for key, value in self.terminals():
            if key < bound:
                below.append((key, value))
            else:
                rest.insert(key, value, None)
        self.root, self.bytes, self.nodes = rest.root, rest.bytes, rest.nodes
        return below


def _better(old: tuple, new: tuple) -> tuple:
    """A value is (rank of the identifier, rows, row that holds the payload)."""
    first = old if old[0] <= new[0] else new
    return (first[0], old[1] + new[1], first[2])


def _rank(identifier: int | None, largest: bool) -> tuple[bool, int]:
    return (True, 0) if identifier is None else (False, -identifier if largest else identifier)


def _inserting(key_at: int, text_at: int, id_at: int, count_at: int, largest: bool, final: bool, budget: int):
    """One pass over a partition: insert, merge, and hand on one row for each terminal.

    Rows that a batch has lost to better ones are dropped batch by batch; the trie holds
    (batch number, row) and only batches that still own terminals are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, kept, number = RadixTrie(), {}, 0

        def rows_of(terminals) -> Iterator[pa.RecordBatch]:
            by_batch: dict[int, list[tuple[int, int]]] = {}
            for _, (_, rows, (where, row)) in terminals:
                by_batch.setdefault(where, []).append((row, rows))
            for where, owners in by_batch.items():
                owners.sort()
                taken = kept[where].take(pa.array([row for row, _ in owners], pa.int64()))
                columns = list(taken.columns)
                columns[count_at] = pa.array([rows for _, rows in owners], pa.int64())
                yield pa.RecordBatch.from_arrays(columns, schema=taken.schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            number += 1
            kept[number] = batch
            keys, texts = batch.column(key_at).to_pylist(), batch.column(text_at)
            ids, counts = batch.column(id_at).to_pylist(), batch.column(count_at).to_pylist()
            for row, key in enumerate(keys):
                value = (_rank(ids[row], largest), counts[row], (number, row))
                trie.insert(key + (texts[row].as_py() or "").encode(), value, _better)
            if trie.held + sum(b.nbytes for b in kept.values()) > budget:
                if final:
                    yield from rows_of(trie.take_below(keys[-1]))
                else:
                    yield from rows_of(trie.terminals())
                    trie = RadixTrie()
                owned = {where for _, (_, _, (where, _)) in trie.terminals()}
                kept = {where: b for where, b in kept.items() if where in owned}
        yield from rows_of(trie.terminals())

    return run


def owners(
    docs: DataFrame, keep: str = "smallest", id_column: str = "doc_id", text_column: str = "text", budget: int = TRIE_BYTES
) -> DataFrame:
    """The row that stays of each distinct text, with all its columns, and `group_size`.

    Where the table has a column of that name, ours gets underscores in front.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    key, text, identifier, count = fresh(docs.columns, "trie_key", "trie_text", "trie_id", "group_size")
    rows = docs.withColumns(
        {
            text: whole_text(text_column),
            identifier: column(id_column).cast("long"),
            count: F.lit(1).cast("long"),
        }
    )
    length = F.lpad(F.hex(F.octet_length(column(text)).cast("long")), 16, "0")
    content = F.lpad(F.hex(F.xxhash64(column(text))), 16, "0")
    rows = rows.withColumn(key, F.unhex(F.concat(length, content)))
    names = rows.columns
    at = [names.index(name) for name in (key, text, identifier, count)]
    largest = keep == "largest"
    partial = map_batches(rows, _inserting(*at, largest, False, budget), rows.schema)
    dealt = partial.repartition(column(key)).sortWithinPartitions(column(key))
    owned = map_batches(dealt, _inserting(*at, largest, True, budget), rows.schema)
    return owned.select(*map(column, docs.columns), column(count))


def assign(
    docs: DataFrame, keep: str = "smallest", id_column: str = "doc_id", text_column: str = "text", budget: int = TRIE_BYTES
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each document.

    Documents meet their owner by length and SHA-256. The owner side has one row for each
    text, so only the documents' side can be skewed, and Spark splits that at run time.
    Rows that are equal in all these columns are counted, not compared: of n such rows
    that tie for a text, one is kept.
    """
    rows = id_and_text(docs, id_column, text_column)
    digest = F.sha2(F.col("text").cast("binary"), 256)
    best = owners(rows, keep, budget=budget).select(
        F.octet_length("text").alias("bytes"), digest.alias("text_sha256"), F.col("doc_id").alias("keep_id"), "group_size"
    )
    each = rows.select("doc_id", F.octet_length("text").alias("bytes"), digest.alias("text_sha256"))
    joined = each.join(best, ["bytes", "text_sha256"]).drop("bytes")
    counted = joined.groupBy("doc_id", "keep_id", "group_size", "text_sha256").agg(F.count("*").alias("rows"))
    # Two steps, so that no array is longer than 2^16 however often a row is repeated.
    block = F.lit(1 << 16)
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {1 << 16}"))))
    last = F.least(F.col("rows") - F.col("block") * block, block)
    repeated = blocks.withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    first = (F.col("block") == 0) & (F.col("place") == 1)
    return repeated.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), "text_sha256")
