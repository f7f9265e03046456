"""Token counts through a digest cache (operator 1).

The cache is a ledger of (digest, version, n_tokens). A text is keyed by
the SHA-256 of its normalised content, a tokenizer by the SHA-256 of its file and
options. Counting joins the documents to the cache, encodes one copy of each text that
is not there, appends those counts, and joins again. Copies, earlier runs and earlier
versions of the corpus therefore cost a join and no encoding.

Null texts count as empty, and empty texts have no tokens. Repeated rows, null ids and
ids that occur twice are counted row by row. A text of any length is encoded whole. An empty
table gives an empty result. Columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarium.llm.common import CHUNK_BYTES, chunks, complete_ledger, content_digest, id_and_text, new_path

#: Part of the key, so that counts made with other options are never reused.
OPTIONS = "sentencepiece;no-bos;no-eos"
#: Distinct words whose counts a worker remembers; beyond it, it starts afresh.
REMEMBERED_WORDS = 250_000
_LONGEST_REMEMBERED = 64
#: Words whose pieces are held at a time: a list of ids takes some 200 bytes, its length is all that is kept.
_ENCODED_WORDS = 16_384
_MARK = "▁"


def tokenizer_digest(model_path: str) -> str:
    """The version of a tokenizer: its file's bytes and the options it is used with."""
    return hashlib.sha256(OPTIONS.encode() + b"\0" + Path(model_path).read_bytes()).hexdigest()


class PieceCounter:
    """Counts pieces as the library does, word by word where that is provably the same.

    A merge crosses a place in a text only if some piece holds the two characters that
    meet there. If no piece has a mark after another character, none crosses into the
    mark that begins a word; if no piece has a line feed, none crosses it on either side.
    With such a model a text counts as the sum of its words and of its line feeds with
    what follows them. Runs of spaces, marks in the text itself, and any other model get
    the library's own count of the whole text.
    """

    def __init__(self, model_path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        probe = " a  b\n "
        untouched = self.library.normalize(probe) == _MARK + probe.replace(" ", _MARK)
        self.by_word = untouched and not any("\n" in p or re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)
        self.known: dict[str, int] = {}

    def _lengths(self, texts: list[str]) -> Iterator[int]:
        """Pieces of each text, on the one core that a task has: by default the library starts a thread for each core."""
        for start in range(0, len(texts), _ENCODED_WORDS):
            yield from map(len, self.library.encode(texts[start : start + _ENCODED_WORDS], num_threads=1))

    def _words(self, words: list[str]) -> np.ndarray:
        """Counts of words as they stand after a space, or after nothing if a line feed begins them."""
        unknown = [w for w in words if w not in self.known]
        # The library puts a mark before every text; no merge joins it to a line feed.
        found = {w: n - w.startswith("\n") for w, n in zip(unknown, self._lengths(unknown), strict=True)}
        counts = np.fromiter((found[w] if w in found else self.known[w] for w in words), np.int64, len(words))
        if len(self.known) + len(found) > REMEMBERED_WORDS:
            self.known.clear()
        self.known.update((w, n) for w, n in found.items() if len(w) <= _LONGEST_REMEMBERED)
        return counts

    def count(self, texts: pa.StringArray) -> np.ndarray:
        if not self.by_word:
            return np.fromiter((n for text in texts for n in self._lengths([text.as_py()])), np.int64, len(texts))
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        words = parts.flatten().dictionary_encode()
        distinct, codes = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        odd = np.fromiter((not w or _MARK in w for w in distinct), bool, len(distinct))
        ends = np.cumsum(pc.list_value_length(parts).to_numpy())

        def per_text(of_word: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(of_word[codes], dtype=np.int64)))[np.concatenate(([0], ends))])

        counts = per_text(self._words(distinct))
        for row in np.flatnonzero(per_text(odd)):
            counts[row] = next(self._lengths([texts[row].as_py()]))
        return counts


@lru_cache(maxsize=2)
def _counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def _encode(model_path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in chunks(batches, 1, 2 * CHUNK_BYTES):
            counts = counter.count(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts)],
                ["digest", "version", "n_tokens"],
            )

    return run


def count_tokens(
    docs: DataFrame, model_path: str, cache_path: str | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, digest, n_bytes, n_tokens), one row for each document.

    cache_path keeps counts between runs; without it, the cache serves this call alone.
    """
    version = tokenizer_digest(model_path)
    path = cache_path or new_path(docs.sparkSession, "token-cache")
    texts = id_and_text(docs, id_column, text_column).withColumn("digest", content_digest(F.col("text")))
    counts = complete_ledger(texts, path, version, "n_tokens long", _encode(model_path, version))
    sizes = texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(counts, "digest").select("doc_id", "digest", "n_bytes", "n_tokens")
