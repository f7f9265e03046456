"""Removal of repeated passages by Rabin-Karp hashes of word windows (operator 12).

Words are runs of characters other than ASCII white space. Every window of `words` words
gets a rolling polynomial hash, 64 bits of one polynomial and 16 of another: sums of word
hash times power of the base, modulo 2^64, from prefix sums. A word goes if a window that
covers it also starts in a document with a smaller id; overlapping windows merge into
maximal intervals. Windows are judged on the input, not on what is left.

Documents are dealt into chunks by content. A chunk sends each range of hashes one block:
its distinct windows, sorted, with the smallest id that holds each. So a passage that a
third of all documents share is one row for each chunk. A range counts the windows of all
chunks and answers each block with a bit for each window, which says whether a smaller id
elsewhere holds it; within the chunk its own ids decide. Chunks and ranges are cut by the
bytes of the corpus, so no task grows with it, and nothing but their number reaches the
driver. The text is shuffled once, to the chunks, and both of a chunk's steps read that shuffle.

Two different windows get one hash with a probability of 2^-80; that is the only way in
which a word could go wrongly. Null texts count as empty. Documents with a null id come
after all others, and rows with equal ids never remove from one another. Repeated rows are
judged row by row, alike. A text of any length is read whole; it is a chunk of its own if
it is longer than one. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarium.llm.blocks import pack, range_bounds, steps, text_bytes, unpack
from bazaarium.llm.common import id_and_text

#: Text bytes of a chunk of documents, and of the corpus for each range of hashes.
CHUNK_TEXT, RANGE_TEXT = 4 << 20, 8 << 20
#: Odd bases of the two polynomials.
_BASES = (0x9E3779B97F4A7C13, 0xD6E8FEB86659FD93)
_LAST_ID = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(hashes: np.ndarray, words: int, base: int) -> np.ndarray:
    """The polynomial over each `words` neighbouring hashes."""
    factors = np.full(len(hashes) + 1, base, np.uint64)
    factors[0] = 1
    inverse = np.full(len(hashes) + 1, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * np.multiply.accumulate(factors)[:-1])))
    return _mix((sums[words:] - sums[:-words]) * np.multiply.accumulate(inverse)[: len(hashes) - words + 1])


@dataclass
class Windows:
    """The words of some texts, and their distinct windows in the order of their hashes."""

    words: pa.StringArray
    ends: np.ndarray  # of each text, in words
    starts: np.ndarray  # of each window, in words
    of: np.ndarray  # the distinct window that each is
    key: np.ndarray
    check: np.ndarray
    least: np.ndarray  # the smallest id that holds it
    own: np.ndarray  # the id of each window


def find_windows(ids: np.ndarray, texts: pa.StringArray, words: int) -> Windows:
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    flat = parts.flatten()
    sizes = pc.list_value_length(parts).to_numpy()
    # a text without words is split into one empty string
    real = pc.not_equal(flat, "")
    without = np.add.reduceat(~real.to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes) if len(sizes) else sizes
    flat, sizes = flat.filter(real), sizes - without
    ends = np.cumsum(sizes)
    coded = flat.dictionary_encode()
    digests = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist()))
    hashes = np.frombuffer(digests, "<u8").reshape(-1, 2)
    codes = coded.indices.to_numpy()
    counts = np.maximum(sizes - words + 1, 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    starts = (ends - sizes)[text] + np.arange(len(text)) - (np.cumsum(counts) - counts)[text]
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return Windows(flat, ends, starts, starts, none, none, ids[:0], ids[:0])
    key, check = (_rolled(hashes[codes, i], words, base)[starts] for i, base in enumerate(_BASES))
    check >>= np.uint64(48)
    order, first = _grouped(key, check)
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(first) - 1
    at, own = np.flatnonzero(first), ids[text]
    return Windows(flat, ends, starts, of, key[order[at]], check[order[at]], np.minimum.reduceat(own[order], at), own)


def _grouped(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by key and check, and which of the ordered are the first of their kind."""
    order = np.argsort(key, kind="stable")
    keys, checks = key[order], check[order]
    same, differ = keys[1:] == keys[:-1], checks[1:] != checks[:-1]
    if (same & differ).any():
        order = np.lexsort((check, key))
        keys, checks = key[order], check[order]
        same, differ = keys[1:] == keys[:-1], checks[1:] != checks[:-1]
    return order, np.concatenate(([True], ~same | differ))


def _read(chunk: pa.Table, words: int) -> tuple[pa.Array, Windows]:
    ids = chunk.column("doc_id").combine_chunks()
    return ids, find_windows(ids.fill_null(_LAST_ID).to_numpy(), chunk.column("text").combine_chunks(), words)


def _sending(words: int, ranges: int):
    def run(key: tuple[pa.Scalar, ...], chunk: pa.Table) -> pa.Table:
        _, found = _read(chunk, words)
        bounds = range_bounds(found.key, ranges)
        held = np.flatnonzero(np.diff(bounds))
        packed = []
        for number in held.tolist():
            part = slice(bounds[number], bounds[number + 1])
            ids, of = np.unique(found.least[part], return_inverse=True)
            packed.append(pack(steps(found.key[part]), found.check[part], of, steps(ids)))
        return pa.table({"range": held, "chunk": pa.array([key[0].as_py()] * len(held), pa.int64()), "block": pa.array(packed, pa.binary())})

    return run


def _judge(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
    """For each block that has any, the bits of its windows that a smaller id of another block holds."""
    columns, ends = [], [0]
    for block in blocks.column("block"):
        moved, check, of, ids = unpack(block.as_buffer())
        columns.append((np.cumsum(moved), check.astype(np.uint16), np.cumsum(ids).view(np.int64)[of.astype(np.int64)]))
        ends.append(ends[-1] + len(check))
    keys, checks, ids = (np.concatenate(c) for c in zip(*columns, strict=True))
    order, first = _grouped(keys, checks)
    at = np.flatnonzero(first)
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], at), np.diff(np.append(at, len(ids))))
    smaller = least < ids
    bits = [pack(np.packbits(smaller[a:b])) if smaller[a:b].any() else None for a, b in zip(ends, ends[1:], strict=False)]
    answered = blocks.select(["chunk", "range"]).append_column("bits", pa.array(bits, pa.binary()))
    return answered.filter(pc.is_valid(answered.column("bits")))


def _removing(words: int, ranges: int):
    def run(key: tuple[pa.Scalar, ...], chunk: pa.Table, answers: pa.Table) -> pa.Table:
        ids, found = _read(chunk, words)
        elsewhere = np.zeros(len(found.key), bool)
        bounds = range_bounds(found.key, ranges)
        for number, bits in zip(answers.column("range").to_pylist(), answers.column("bits"), strict=True):
            part = slice(bounds[number], bounds[number + 1])
            packed = unpack(bits.as_buffer())[0].astype(np.uint8)
            elsewhere[part] = np.unpackbits(packed, count=part.stop - part.start).astype(bool)
        goes = elsewhere[found.of] | (found.least[found.of] < found.own)
        return _without(ids, found, found.starts[goes], words)

    return run


def _without(ids: pa.Array, found: Windows, starts: np.ndarray, words: int) -> pa.Table:
    """Each text without the words of the windows that begin at starts."""
    total = len(found.words)
    change = np.zeros(total + 1, np.int64)
    change[starts] += 1
    np.subtract.at(change, starts + words, 1)
    covered = np.cumsum(change)[:-1] > 0
    gone = np.concatenate(([0], np.cumsum(covered)))
    sizes = np.diff(found.ends, prepend=0)
    n_removed = np.diff(gone[found.ends], prepend=0)
    begins = found.ends - sizes
    # intervals end with their text, so that those of two texts never merge
    opens, closes = covered.copy(), covered.copy()
    opens[1:] &= ~covered[:-1]
    closes[:-1] &= ~covered[1:]
    edges = begins[(sizes > 0)]
    opens[edges] |= covered[edges]
    closes[edges[1:] - 1] |= covered[edges[1:] - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    text = np.searchsorted(found.ends, first, side="right")
    pairs = pa.StructArray.from_arrays(
        [pa.array(first - begins[text], pa.int64()), pa.array(last - begins[text], pa.int64())], ["start", "stop"]
    )
    intervals = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(sizes)))))
    kept_ends = found.ends - gone[found.ends]
    kept = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], kept_ends)), pa.int32()), found.words.filter(pa.array(~covered))
    )
    return pa.table(
        {
            "doc_id": ids,
            "n_words": pa.array(sizes, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "removed": pa.ListArray.from_arrays(pa.array(intervals, pa.int32()), pairs),
            "kept_text": pc.binary_join(kept, " "),
        }
    )


def remove_repeats(
    docs: DataFrame,
    words: int = 13,
    id_column: str = "doc_id",
    text_column: str = "text",
    chunk_text: int = CHUNK_TEXT,
    range_text: int = RANGE_TEXT,
) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_text), one row for each document.

    removed has the maximal intervals of removed words (start, stop); kept_text is what is
    left, joined by one space.
    """
    texts = id_and_text(docs, id_column, text_column)
    total = text_bytes(texts)
    chunks, ranges = total // chunk_text + 1, total // range_text + 1
    # The partition's number spreads rows that are equal in all.
    chunk = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("long")
    dealt = texts.select(chunk.alias("chunk"), "doc_id", "text").groupBy("chunk")
    blocks = dealt.applyInArrow(_sending(words, ranges), "range long, chunk long, block binary")
    answers = blocks.groupBy("range").applyInArrow(_judge, "chunk long, range long, bits binary")
    schema = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,stop:long>>, kept_text string"
    return dealt.cogroup(answers.groupBy("chunk")).applyInArrow(_removing(words, ranges), schema)
