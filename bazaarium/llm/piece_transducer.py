"""SentencePiece encoding and decoding as a weighted transducer (operator 9).

Three machines are compiled from a model file. The normaliser writes a mark for every
space and one in front of the text. The piece machine is a set of paths, one for each
piece, that read its characters and emit its id; a character that no piece has alone is
read by a fallback path that emits its UTF-8 bytes. The gate reads ids in pairs. For a
unigram model it lets all pass and a piece weighs minus its score. For a byte-pair model
a pair passes with weight 0 if merging its characters by rank gives just that pair, and
with infinite weight otherwise: byte-pair encoding is the only sequence whose every
neighbouring pair passes. Encoding composes a text with the machines and takes the
shortest path in the tropical semiring (min, +), position by position.

Where no piece holds the two characters that meet, every path passes through one state,
so a text is cut there and equal stretches share one composition.

Decoding runs the piece machine backwards: pieces to characters, byte pieces to bytes
(bytes that are not UTF-8 become U+FFFD), marks to spaces, without the mark in front. A
text that itself holds the mark comes back with a space, as with the library; every
other text comes back as it was.

Null texts count as empty, which have no pieces. Repeated rows and null ids are encoded
row by row. A text of any length is encoded whole. An empty table gives an empty result; other columns are ignored. Models that
rewrite characters first (a compiled character map) are refused.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from bazaarium.llm.common import CHUNK_BYTES, chunks, id_and_text

MARK = "▁"
#: Stretches whose ids, and pairs whose passage, a worker remembers; beyond it, it starts afresh.
REMEMBERED, REMEMBERED_PAIRS = 1_000_000, 400_000
_LONGEST_REMEMBERED = 64
_INFINITE = float("inf")
#: What bytes weigh beside pieces of a unigram model, whose weights are far smaller.
_FALLBACK_WEIGHT = 100.0


UNIGRAM, BYTE_PAIR = 1, 2


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised protocol-buffer message: whole numbers, or raw bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            value |= (message[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if message[at - 1] < 0x80:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, message[at : at + size]
            at += size


def _settings(model: bytes) -> tuple[int, dict[int, int | bytes]]:
    """The model's type, and the normaliser's settings by field number."""
    parts = {number: value for number, value in _fields(model) if number in (2, 3)}
    return dict(_fields(parts[2])).get(3, UNIGRAM), dict(_fields(parts.get(3, b"")))


class Normaliser:
    """Spaces to marks, a mark in front, and runs of spaces to one, as far as the model says so."""

    def __init__(self, settings: dict[int, int | bytes]):
        if settings.get(2) or not settings.get(5, 1):
            raise ValueError("models that rewrite characters or keep spaces are not compiled")
        self.prefix, self.squeeze = bool(settings.get(3, 1)), bool(settings.get(4, 1))

    def __call__(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)


class PieceTransducer:
    def __init__(self, model_path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        kind, settings = _settings(library.serialized_model_proto())
        if kind not in (UNIGRAM, BYTE_PAIR):
            raise ValueError("only unigram and byte-pair models are compiled")
        self.by_rank, self.normalise = kind == BYTE_PAIR, Normaliser(settings)
        self.pieces: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = array("I", [0] * 256)
        self.unknown, fallback = library.unk_id(), False
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)], fallback = i, True
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif library.is_control(i) or library.is_unknown(i) or library.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.pieces[piece] = i
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        if not fallback:
            raise ValueError("the model has no byte fallback")
        self.scores = [library.get_score(i) for i in range(library.get_piece_size())]
        self.spelt = {i: piece for piece, i in self.pieces.items()}
        self.longest = max(map(len, self.pieces))
        met = {piece[k : k + 2] for piece in self.pieces for k in range(len(piece) - 1)}
        #: Places that no piece spans: before a mark that follows something else, and around line feeds.
        simple = not any(a != MARK and b == MARK or "\n" in (a, b) for a, b in met) and "\n" not in self.pieces
        self.stretches = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall if simple else lambda text: [text]
        #: ASCII punctuation that no piece has right after a letter; between the two, too, a text is cut.
        after_letter = {b for a, b in met if a.isalpha()}
        self.closing = "".join(c for c in string.punctuation if c not in after_letter) if simple else ""
        self._compile()
        self.known: dict[str, bytes] = {}
        self.passing: dict[int, bool] = {}

    def _compile(self) -> None:
        """The piece machine, read backwards: every end of a piece -> the piece's id, or -1 if it is only an end.

        Of a byte-pair model, pieces that merging their characters never gives are left out.
        """
        self.ends: dict[str, int] = {}
        for piece, i in self.pieces.items():
            for k in range(1, len(piece)):
                self.ends.setdefault(piece[k:], -1)
            if not self.by_rank or self._merged(piece) == [piece]:
                self.ends[piece] = i

    # --- the gate ---

    def _merged(self, text: str) -> list[str]:
        """Merges by rank: the best neighbouring pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -_INFINITE, -1
            for k in range(len(parts) - 1):
                joined = self.pieces.get(parts[k] + parts[k + 1])
                if joined is not None and self.scores[joined] > best:
                    best, at = self.scores[joined], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _passes(self, before: int, piece: int) -> bool:
        left, right = self.spelt[before], self.spelt[piece]
        if len(self.passing) >= REMEMBERED_PAIRS:
            self.passing.clear()
        passes = self.passing[before << 32 | piece] = self._merged(left + right) == [left, right]
        return passes

    # --- composition and shortest path ---

    def _compose(self, text: str) -> array:
        """The shortest path through one stretch. weight[k], last[k]: the state after k characters.

        With a byte-pair gate at most one path reaches a position, so a position is a state.
        """
        n, by_rank, passing, ends = len(text), self.by_rank, self.passing, self.ends
        weight, last, back = [_INFINITE] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        weight[0] = 0.0
        for end in range(1, n + 1):
            least = _INFINITE
            for start in range(end - 1, -1, -1):
                piece = ends.get(text[start:end])
                if piece is None:  # no piece ends like this
                    break
                if piece < 0 or weight[start] == _INFINITE:
                    continue
                cost = weight[start]
                if by_rank:
                    if (before := last[start]) >= 0:
                        passes = passing.get(before << 32 | piece)
                        if passes is False or passes is None and not self._passes(before, piece):
                            continue
                else:
                    cost -= self.scores[piece]
                if cost < least:
                    least, last[end], back[end] = cost, piece, start
                    if not cost and by_rank:  # nothing weighs less
                        break
            if text[end - 1] not in self.pieces:  # the fallback path
                cost = weight[end - 1] + (0.0 if by_rank else _FALLBACK_WEIGHT)
                if cost < least:
                    least, last[end], back[end] = cost, -1, end - 1
            weight[end] = least
        path, at = [], n
        while at:
            path.append((last[at], back[at], at))
            at = back[at]
        ids = array("I")
        for piece, start, end in reversed(path):
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(self.byte_ids[b] for b in text[start:end].encode())
        return ids

    def _stretch(self, text: str) -> bytes:
        ids = self.known.get(text)
        if ids is None:
            word = text.rstrip(self.closing)
            if word and len(word) < len(text) and word[-1].isalpha():
                ids = self._stretch(word) + self._stretch(text[len(word) :])
            else:
                ids = self._compose(text).tobytes()
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(text) <= _LONGEST_REMEMBERED:
                self.known[text] = ids
        return ids

    def encode(self, text: str) -> array:
        ids = array("I")
        ids.frombytes(b"".join(map(self._stretch, self.stretches(self.normalise(text)))))
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.normalise.prefix and text.startswith(" ") else text


@lru_cache(maxsize=1)
def transducer(model_path: str) -> PieceTransducer:
    return PieceTransducer(model_path)


def _encoding(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        for batch in chunks(batches, 1, CHUNK_BYTES):
            texts = batch.column(1).to_pylist()
            ids = [machine.encode(text) for text in texts]
            back = [machine.decode(i) == text for i, text in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([np.array(i, np.int32) for i in ids], pa.list_(pa.int32())),
                    pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                    pa.array(back, pa.bool_()),
                ],
                ["doc_id", "ids", "ids_crc32", "round_trip"],
            )

    return run


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids, ids_crc32 of little-endian 32-bit ids, round_trip: whether decoding gives the text)."""
    schema = "doc_id long, ids array<int>, ids_crc32 long, round_trip boolean"
    return id_and_text(docs, id_column, text_column).mapInArrow(_encoding(model_path), schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        for batch in batches:
            texts = [machine.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
