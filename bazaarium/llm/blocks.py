"""Columns of whole numbers as compressed bytes, for what travels between chunks of documents and key ranges.

A chunk of documents sends each range of keys one block and gets one block back, row for
row. Numbers are written byte plane by byte plane, as many as the largest needs, so that
sorted keys, sent as differences, and small counts cost the bytes that they carry.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEAD = struct.Struct("<QB")


def pack(*columns: np.ndarray) -> bytes:
    """Columns as unsigned 64-bit numbers; negative ones keep their bits."""
    parts = []
    for column in columns:
        wide = np.ascontiguousarray(column).astype(np.uint64)
        used = (int(wide.max()).bit_length() + 7) // 8 if len(wide) else 0
        planes = wide.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :used]
        parts += [_HEAD.pack(len(wide), used), np.ascontiguousarray(planes.T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, columns = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, used = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        bytes_of = np.zeros((n, 8), np.uint8)
        bytes_of[:, :used] = np.frombuffer(raw, np.uint8, n * used, at).reshape(used, n).T
        at += n * used
        columns.append(bytes_of.view("<u8").ravel().astype(np.uint64, copy=False))
    return columns


def steps(values: np.ndarray) -> np.ndarray:
    """The first value and the differences, modulo 2^64; `np.cumsum` undoes it."""
    wide = values.astype(np.uint64)
    return np.diff(wide, prepend=np.uint64(0))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... of so many elements each, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def range_bounds(key: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins in sorted 64-bit keys, whose upper half says which range is theirs."""
    of = ((key >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64))


def text_bytes(texts: DataFrame) -> int:
    """All UTF-8 bytes of the column text."""
    return texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
