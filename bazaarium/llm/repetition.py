"""Quality rules on repetition inside a document (operator 2).

Words are runs of characters other than ASCII white space. Each word gets a number, and
rolling hashes over those numbers, for every length of n-gram, find the n-grams that a
text holds more than once; the characters of words under any repeat, first occurrences
not counted, are the coverage at that length. Lines that repeat an earlier line are measured likewise. A document is
rejected if a share is above its limit, and before that by the base rules: too few
words, or too many words under repeated windows of three. Limits depend on length: repeats
of no more than passage_chars characters, such as a boilerplate line that stands twice,
are held to the wide limits, and longer ones to the narrow limits for passages, which a
passage that occurs twice can exceed in a document that the base rules let pass.

Null texts count as texts without words; so do empty ones. Repeated rows and null ids
are judged row by row. An empty table gives an empty result; other columns pass through
`keep_good` and are ignored by `measure`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bazaarium.llm.common import CHUNK_BYTES, chunks, column, fresh, id_and_text, map_batches, whole_text

_SPACE = b" \t\n\x0b\x0c\r"
#: UTF-8 bytes that do not begin a character.
_INNER = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_WINDOW = 3
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    """Limits; a share is of the characters in words."""

    min_words: int = 50
    max_repeat_words_percent: int = 50
    #: Length of n-gram -> largest share of characters under repeats.
    ngram_shares: tuple[tuple[int, float], ...] = ((5, 0.30), (6, 0.29), (7, 0.28), (8, 0.27), (9, 0.26), (10, 0.25))
    #: Largest share of characters in lines that repeat an earlier one.
    line_share: float = 0.30
    #: The same for repeats of more than passage_chars characters.
    passage_chars: int = 100
    ngram_passage_shares: tuple[float, ...] = (0.15, 0.14, 0.13, 0.12, 0.11, 0.10)
    line_passage_share: float = 0.20

    def above(self, chars: int, total: int, share: float, passage_share: float) -> bool:
        return chars > share * total or (chars > self.passage_chars and chars > passage_share * total)


@dataclass(frozen=True)
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    dup_line_chars: int
    dup_ngram_chars: tuple[int, ...]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def word_characters(text: bytes) -> int:
    return len(text.translate(None, _INNER + _SPACE))


def _under_repeats(codes: np.ndarray, n: int, words: int, first: bool) -> np.ndarray:
    """Which words lie under an n-gram whose code occurs more than once, the first one counted or not."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    repeated = np.zeros(len(codes), bool)
    repeated[order[1:]] = same
    if first:
        repeated[order[:-1]] |= same
    edges = np.zeros(words + 1, np.int64)
    edges[: len(codes)] += repeated
    edges[n : n + len(codes)] -= repeated
    return np.cumsum(edges[:-1]) > 0


def _triples(numbers: np.ndarray, distinct: int) -> np.ndarray:
    """Codes that are equal for equal windows of three and for no others."""
    pairs = numbers[:-1] * distinct + numbers[1:]
    if distinct >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    return pairs[:-1] * distinct + numbers[2:]


def measure_text(text: bytes, rules: Rules = Rules()) -> Measures:
    words = text.split()
    total = word_characters(text)
    symbols = len(text) - len(text.translate(None, _SYMBOLS))

    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            if line.strip(_SPACE):
                dup_lines += 1
                dup_line_chars += word_characters(line)
        else:
            seen.add(line)

    book = _Numbers()
    numbers = np.fromiter(map(book.__getitem__, words), np.int64, len(words))
    repeat_words, covered = 0, [0] * len(rules.ngram_shares)
    if len(words) >= _WINDOW:
        repeat_words = int(_under_repeats(_triples(numbers, len(book)), _WINDOW, len(words), True).sum())
    if repeat_words:  # a longer n-gram that repeats has windows of three that repeat
        weights = np.fromiter(map(word_characters, book), np.int64, len(book))[numbers]
        mixed = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        codes, length = mixed, 1
        for place, (n, _) in enumerate(rules.ngram_shares):
            while length < n and len(codes) > 1:
                codes = codes[:-1] * _FACTOR + mixed[length:]
                length += 1
            if length < n:
                break
            covered[place] = int(weights[_under_repeats(codes, n, len(words), False)].sum())
            if not covered[place]:
                break
    failed = len(words) < rules.min_words or 100 * repeat_words > rules.max_repeat_words_percent * len(words)
    above = rules.above(dup_line_chars, total, rules.line_share, rules.line_passage_share) or any(
        rules.above(chars, total, share, passage_share)
        for chars, (_, share), passage_share in zip(covered, rules.ngram_shares, rules.ngram_passage_shares, strict=True)
    )
    return Measures(
        len(words), total, symbols, dup_lines, repeat_words, failed, not failed and not above, dup_line_chars, tuple(covered)
    )


def _bytes(texts: pa.Array) -> Iterator[bytes]:
    return (text.as_buffer().to_pybytes() if text.is_valid else b"" for text in texts)


def measure(docs: DataFrame, rules: Rules = Rules(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The measures and the verdict of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, CHUNK_BYTES):
            found = [measure_text(text, rules) for text in _bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([getattr(m, name) for m in found], kind) for name, kind in shown),
                    pa.array([list(m.dup_ngram_chars) for m in found], pa.list_(pa.int64())),
                ],
                ["doc_id", *(name for name, _ in shown), "dup_ngram_chars"],
            )

    shown = [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    shown += [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("dup_line_chars", pa.int64())]
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, dup_line_chars long, dup_ngram_chars array<long>"
    )
    return id_and_text(docs, id_column, text_column).mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_column: str = "text") -> DataFrame:
    """The rows whose texts pass, with all their columns. One pass, no shuffle."""
    (text,) = fresh(docs.columns, "judged_text")
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, width, CHUNK_BYTES):
            good = pa.array([measure_text(t, rules).kept for t in _bytes(batch.column(width))], pa.bool_())
            yield batch.select(list(range(width))).filter(good)

    rows = docs.select(*map(column, docs.columns), whole_text(text_column).alias(text))
    return map_batches(rows, run, docs.schema)
