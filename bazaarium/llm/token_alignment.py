"""Alignment of two tokenizers by interval coalescing (operator 13).

A text is encoded by a byte-level tokenizer (A, which is given the text behind a space) and
by a piece model (B, which adds the space). Tokens become byte intervals. All intervals of
a batch of texts, laid end to end, are sorted by their start; a group breaks where a start
reaches the running maximum of the ends. So groups are cut at the offsets where tokens of
both end. Every A token of a group is linked to every B token of it.

A pair of ids counts the documents that hold it linked. A chunk of texts adds up its
distinct pairs and sends each range of A ids one block; a range adds up all chunks, finds
the highest count of each A id, and answers row for row. What a chunk has found is stored
with the documents' pairs as numbers of the chunk's list, so texts are encoded once and a
lost executor costs a reread. Ranges are cut by a hash of the A id; a pair that every
document holds is one row for each chunk. The driver gets the number of bytes and no more.

Both encode word by word where that is provably the same: a space between two characters
that are no white space always begins a token of A, and no piece of B crosses it if none
has a mark after another character. Distinct words are encoded once for a batch. Any other
text, and any other tokenizer, is encoded whole.

Documents that are null or empty, or whose tokens do not spell the space and the text byte
by byte (B drops or rewrites something), have no tokens: zeros and the digest ''. Repeated
rows and null ids are documents each. A text of any length is encoded whole, and the links
of a group of any size are added up by distinct ids in bounded steps. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bazaarium.llm.blocks import pack, ragged, steps, text_bytes, unpack
from bazaarium.llm.common import CHUNK_BYTES, chunks, id_and_text, stored

#: Text bytes of a chunk, and of the corpus for each range of A ids; ranges are at least and at most so many.
CHUNK_TEXT, RANGE_TEXT, LEAST_RANGES, MOST_RANGES = CHUNK_BYTES // 2, 64 << 20, 64, 1 << 15
#: Words whose ids a worker remembers, their bytes at most, and words that are encoded at a time.
REMEMBERED, _LONGEST_REMEMBERED, _AT_A_TIME = 250_000, 64, 4096
#: Links of a group from which on they are added up by distinct ids, and pairs of one such step.
LARGE_GROUP, STEP = 4096, 1 << 20
_MARK = "▁"


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Side A: a byte-level tokenizer without special tokens."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_padding()
        self.library.no_truncation()
        made = json.loads(Path(path).read_text(encoding="utf-8"))
        before = made.get("pre_tokenizer") or {}
        self.by_word = made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        alphabet = _byte_alphabet()
        tokens = (self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size()))
        self.spelled = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in tokens]
        self.lengths = np.array([len(s) for s in self.spelled], np.int64)

    def encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has.

        Words that neither begin nor end with white space are encoded as one text, in which
        each begins a token, and its tokens are told apart by their bytes.
        """
        shown = words.to_pylist()
        if pc.any(pc.match_substring_regex(words, r"^[\x00-\x20]|[\x00-\x20]$"), min_count=0).as_py():
            return joined(self.encode(shown))
        ids = np.array(self.encode([" ".join(shown)])[0], np.int32)
        token_ends = np.cumsum(self.lengths[ids])
        word_ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        last = np.searchsorted(token_ends, word_ends)
        if last[-1] != len(ids) - 1 or not np.array_equal(token_ends[last], word_ends):
            return joined(self.encode(shown))
        return ids, np.diff(last, prepend=-1).astype(np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]


class Pieces:
    """Side B: a piece model, which puts a space before each text."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        probe = " a  b\n "
        untouched = self.library.normalize(probe) == _MARK + probe.replace(" ", _MARK)
        self.by_word = untouched and not any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)
        self.spelled = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)
        ]

    def encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        return joined(self.encode(words.to_pylist()))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


def joined(encoded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after the other, and their lengths."""
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    return np.fromiter(chain.from_iterable(encoded), np.int32, int(sizes.sum())), sizes.astype(np.int32)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.sides = (ByteLevel(a_path), Pieces(b_path))
        self.by_word = all(side.by_word for side in self.sides)
        self.sizes = [np.array([len(s) for s in side.spelled], np.int64) for side in self.sides]
        self.spelled = [pa.array(side.spelled, pa.large_binary()) for side in self.sides]
        #: Every id of A, then of B, with each of the three characters that can follow it.
        self.decimals = pa.array((f"{i}{c}" for s in self.spelled for i in range(len(s)) for c in ",|;"), pa.large_string())
        self.pieces = len(self.sides[1].spelled)
        self._forget()

    def _forget(self) -> None:
        #: Where each remembered word is, and of each side the ids of all words and how many each has.
        self.known: dict[str, int] = {}
        self.held = [(np.zeros(0, np.int32), np.zeros(0, np.int32)) for _ in self.sides]

    def _ids(self, words: pa.StringArray, whole: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all units, words before whole texts, and how many each unit has.

        Where too many words are remembered, those of earlier batches are forgotten.
        """
        short = pc.less_equal(pc.binary_length(words), _LONGEST_REMEMBERED).to_numpy(zero_copy_only=False)
        shown = words.filter(pa.array(short)).to_pylist()
        if len(self.known) > REMEMBERED:
            self._forget()
        at = np.fromiter(map(self.known.get, shown, repeat(-1)), np.int64, len(shown))
        new = np.flatnonzero(at < 0)
        at[new] = len(self.known) + np.arange(len(new))
        missing = words.filter(pa.array(short)).take(pa.array(new))
        long = words.filter(pa.array(~short)).to_pylist() + whole
        beyond = len(self.known) + len(new) + np.arange(len(long))
        places = np.empty(len(words) + len(whole), np.int64)
        places[: len(words)][short] = at
        places[: len(words)][~short] = beyond[: len(long) - len(whole)]
        places[len(words) :] = beyond[len(long) - len(whole) :]
        found = []
        for number, side in enumerate(self.sides):
            made = [side.encode_words(missing.slice(start, _AT_A_TIME)) for start in range(0, len(missing), _AT_A_TIME)]
            flat, sizes = (np.concatenate(parts) for parts in zip(self.held[number], *made, strict=True))
            self.held[number] = flat, sizes
            if long:  # not remembered
                flat, sizes = (np.concatenate(parts) for parts in zip((flat, sizes), joined(side.encode(long)), strict=True))
            sizes = sizes.astype(np.int64)
            first = np.cumsum(sizes) - sizes
            found.append((flat[ragged(first[places], sizes[places])].astype(np.int64), sizes[places]))
        self.known.update(zip((shown[i] for i in new.tolist()), at[new].tolist(), strict=True))
        return found

    def encode(self, texts: pa.StringArray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts, none of them empty, and how many each text has."""
        if self.by_word:
            odd = pc.or_(pc.match_substring_regex(texts, r"^\s|\s$"), pc.match_substring(texts, _MARK))
            # white space beyond ASCII, and spaces beside other white space, are left to the whole text
            odd = pc.or_(odd, pc.match_substring_regex(texts, r"\s [^\s]|[^\s] \s|\s \s|[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]"))
            odd = odd.to_numpy(zero_copy_only=False)
        else:
            odd = np.ones(len(texts), bool)
        order = np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))
        back = np.argsort(order)
        words = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        coded = words.flatten().dictionary_encode()
        whole = texts.filter(pa.array(odd)).to_pylist()
        n = len(coded.dictionary)
        codes = np.concatenate((coded.indices.to_numpy().astype(np.int64), np.arange(n, n + len(whole))))
        per_text = np.concatenate((pc.list_value_length(words).to_numpy(), np.ones(len(whole), np.int64)))[back]
        ends = np.cumsum(np.concatenate((pc.list_value_length(words).to_numpy(), np.ones(len(whole), np.int64))))
        starts = (ends - np.diff(ends, prepend=0))[back]
        codes = codes[ragged(starts, per_text)]
        encoded = []
        for ids, sizes in self._ids(coded.dictionary, whole):
            first = np.cumsum(sizes) - sizes
            flat = ids[ragged(first[codes], sizes[codes])]
            total = np.concatenate(([0], np.cumsum(sizes[codes])))
            at = np.concatenate(([0], np.cumsum(per_text)))
            encoded.append((flat, np.diff(total[at])))
        return encoded

    def spells(self, texts: pa.StringArray, side: int, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which texts, behind a space, are what the tokens spell."""
        data = self.spelled[side].take(pa.array(ids)).buffers()[2]
        data = memoryview(data) if data is not None else memoryview(b"")
        lengths = np.concatenate(([0], np.cumsum(self.sizes[side][ids])))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        same = [
            stop - start == len(t) + 1 and data[start : start + 1] == b" " and data[start + 1 : stop] == t
            for start, stop, t in zip(lengths, lengths[1:], (memoryview(t.as_buffer()) for t in texts), strict=False)
        ]
        return np.array(same, bool)

    def align(self, texts: pa.StringArray) -> Alignment:
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        some = texts.filter(pa.array(full))
        encoded = self.encode(some)
        good = np.logical_and(*(self.spells(some, side, *encoded[side]) for side in range(2)))
        sound = np.zeros(len(texts), bool)
        sound[np.flatnonzero(full)[good]] = True
        kept = [(ids[np.repeat(good, sizes)], sizes[good]) for ids, sizes in encoded]
        return Alignment(self, sound, *kept[0], *kept[1])


class Alignment:
    """The groups of some texts; `sound` says which of them have tokens."""

    def __init__(self, by: Aligner, sound: np.ndarray, a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray):
        self.by, self.sound, self.a, self.b, self.a_sizes, self.b_sizes = by, sound, a, b, a_sizes, b_sizes
        lengths = np.concatenate((by.sizes[0][a], by.sizes[1][b]))
        n = len(a)
        ends = np.concatenate((np.cumsum(lengths[:n]), np.cumsum(lengths[n:])))
        starts = ends - lengths
        order = np.argsort(starts, kind="stable")  # A before B where both start; two ordered runs
        reached = np.maximum.accumulate(ends[order])
        breaks = np.ones(len(order), bool)
        breaks[1:] = starts[order][1:] >= reached[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(breaks) - 1
        self.of_a, self.of_b = group[:n], group[n:]
        groups = int(breaks.sum())
        self.n_a, self.n_b = (np.bincount(g, minlength=groups) for g in (self.of_a, self.of_b))
        # texts end where both end, so the last A token of a text is in its last group
        self.group_ends = self.of_a[np.cumsum(a_sizes) - 1] + 1 if len(a_sizes) else np.zeros(0, np.int64)

    def per_text(self, of_group: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(of_group)))[np.concatenate(([0], self.group_ends))])

    def texts_of_groups(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.group_ends)), np.diff(self.group_ends, prepend=0))

    def rendered(self) -> tuple[memoryview, list[int]]:
        """All groups as `a1,a2|b1;...;`, and where each text ends in it, behind its last `;`."""
        before_a, before_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        at_a = np.arange(len(self.a)) + before_b[self.of_a]
        at_b = np.arange(len(self.b)) + (before_a + self.n_a)[self.of_b]
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (self.of_a, self.of_b))
        offset = 3 * len(self.by.spelled[0])
        shown = np.empty(len(self.a) + len(self.b), np.int64)
        shown[at_a] = 3 * self.a + last_a
        shown[at_b] = offset + 3 * self.b + 2 * last_b
        written = self.by.decimals.take(pa.array(shown))
        offsets = np.frombuffer(written.buffers()[1], np.int64)[: len(shown) + 1]
        return memoryview(written.buffers()[2] or b""), offsets[np.cumsum(self.a_sizes + self.b_sizes)].tolist()

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links): each text's distinct linked pairs, as a * pieces + b, ordered."""
        links = self.n_a * self.n_b
        small = links <= LARGE_GROUP
        text_of = self.texts_of_groups()
        in_a = small[self.of_a]
        of = self.of_a[in_a]
        first_b = np.cumsum(self.n_b) - self.n_b
        partner = self.b[ragged(first_b[of], self.n_b[of])]
        found = [(np.repeat(text_of[of], self.n_b[of]), np.repeat(self.a[in_a], self.n_b[of]) * self.by.pieces + partner, None)]
        first_a = np.cumsum(self.n_a) - self.n_a
        for g in np.flatnonzero(~small).tolist():
            a, times_a = np.unique(self.a[first_a[g] : first_a[g] + self.n_a[g]], return_counts=True)
            b, times_b = np.unique(self.b[first_b[g] : first_b[g] + self.n_b[g]], return_counts=True)
            rows = max(1, STEP // len(b))
            for start in range(0, len(a), rows):
                part = slice(start, start + rows)
                pairs = (a[part, None] * self.by.pieces + b).ravel()
                found.append((np.full(len(pairs), text_of[g]), pairs, (times_a[part, None] * times_b).ravel()))
        texts, pairs = (np.concatenate([f[i] for f in found]) for i in range(2))
        # one number for text and pair sorts several times as fast as two
        every = len(self.by.spelled[0]) * self.by.pieces
        keys = texts * every + pairs
        if len(found) == 1:
            keys.sort()
            at = np.flatnonzero(np.diff(keys, prepend=-1))
            counts = np.diff(np.append(at, len(keys)))
        else:
            times = np.concatenate([np.ones(len(f[0]), np.int64) if f[2] is None else f[2] for f in found])
            order = np.argsort(keys)
            keys = keys[order]
            at = np.flatnonzero(np.diff(keys, prepend=-1))
            counts = np.add.reduceat(times[order], at)
        return keys[at] // every, keys[at] % every, counts


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def align(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups): the alignment itself, `a1,a2|b1;a3|b2,b3` in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, CHUNK_TEXT):
            found = _aligner(a_path, b_path).align(batch.column(1))
            written, ends = found.rendered()
            groups = [bytes(written[a : b - 1]).decode() for a, b in zip([0, *ends], ends, strict=False)]
            shown = np.full(batch.num_rows, "", object)
            shown[found.sound] = groups
            yield pa.RecordBatch.from_arrays([batch.column(0), *_counts(found), pa.array(shown, pa.string())], [*_NAMES, "groups"])

    return id_and_text(docs, id_column, text_column).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string")


_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


def _counts(found: Alignment) -> list[pa.Array]:
    groups = np.diff(found.group_ends, prepend=0)
    each = []
    for values in (found.a_sizes, found.b_sizes, groups, found.per_text(found.n_a * found.n_b)):
        all_texts = np.zeros(len(found.sound), np.int64)
        all_texts[found.sound] = values
        each.append(pa.array(all_texts))
    return each


def _range_of(a: np.ndarray, ranges: int) -> np.ndarray:
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(ranges)).astype(np.int64)


_ROW = "struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>"
_FOUND = f"chunk string, range int, rows array<{_ROW}>, block binary"


def _aligning(a_path: str, b_path: str, ranges: int):
    """Texts -> for each chunk a row of its documents and their pairs, and a row for each range of A ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _aligner(a_path, b_path)
        for batch in chunks(batches, 1, CHUNK_TEXT):
            found = by.align(batch.column(1))
            written, ends = found.rendered()
            digests = np.full(batch.num_rows, "", object)
            digests[found.sound] = [hashlib.sha256(written[a : b - 1]).hexdigest() for a, b in zip([0, *ends], ends, strict=False)]
            texts, pairs, links = found.pairs()
            distinct, of = np.unique(pairs, return_inverse=True)
            in_range = _range_of(distinct // by.pieces, ranges)
            order = np.argsort(in_range, kind="stable")
            places = np.empty_like(order)
            places[order] = np.arange(len(order))
            place = places[of]
            documents = np.bincount(place, minlength=len(order))
            held = np.zeros(batch.num_rows, np.int64)
            held[found.sound] = np.bincount(texts, minlength=len(found.group_ends))
            by_text = np.argsort(texts * len(order) + place)
            sorted_pairs, bounds = distinct[order], np.searchsorted(in_range[order], np.arange(ranges + 1))
            used = np.flatnonzero(np.diff(bounds)).tolist()
            blocks = [pack(steps(sorted_pairs[bounds[r] : bounds[r + 1]]), documents[bounds[r] : bounds[r + 1]]) for r in used]
            columns = [batch.column(0), *_counts(found), pa.array(digests, pa.string())]
            rows = pa.StructArray.from_arrays(columns, [*_NAMES, "groups_sha256"])
            lists = pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.nulls(len(used), pa.list_(rows.type))])
            own = pack(held, steps(place[by_text]), links[by_text])
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex] * (1 + len(used))), pa.array([None, *used], pa.int32()), lists, pa.array([own, *blocks], pa.binary())],
                ["chunk", "range", "rows", "block"],
            )

    return run


def _adding(pieces: int):
    def run(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
        """Each block's pairs with the documents of the corpus that hold them, and whether no other pair of the A id has more."""
        read = [unpack(block.as_buffer()) for block in blocks.column("block")]
        pairs = np.concatenate([np.cumsum(r[0]) for r in read]).astype(np.int64)
        distinct, of = np.unique(pairs, return_inverse=True)
        documents = np.zeros(len(distinct), np.int64)
        np.add.at(documents, of, np.concatenate([r[1] for r in read]).astype(np.int64))
        ids = distinct // pieces
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        highest = np.repeat(np.maximum.reduceat(documents, first), np.diff(np.append(first, len(ids))))
        best = documents == highest
        ends = np.cumsum([len(r[0]) for r in read])
        answers = [pack(documents[at], best[at]) for at in np.split(of, ends[:-1])]
        return blocks.select(["chunk", "range"]).append_column("answer", pa.array(answers, pa.binary()))

    return run


def _scoring(key: tuple[pa.Scalar, ...], found: pa.Table, answers: pa.Table) -> pa.Table:
    rows = found.column("rows").combine_chunks().flatten()
    held, moved, links = unpack(found.column("block")[0].as_buffer())
    order = np.argsort(answers.column("range").to_numpy())
    read = [unpack(answers.column("answer")[i].as_buffer()) for i in order.tolist()]
    documents, best = (np.concatenate([r[i] for r in read]).astype(np.int64) if read else np.zeros(0, np.int64) for i in range(2))
    place, links = np.cumsum(moved).astype(np.int64), links.astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(held.astype(np.int64))))
    sums = [np.diff(np.concatenate(([0], np.cumsum(values)))[ends]) for values in (links * best[place], links * documents[place])]
    names = [*_NAMES, "groups_sha256"]
    return pa.table({n: rows.field(n) for n in names} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])})


def link_counts(
    docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", range_text: int = RANGE_TEXT
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), one row for each document.

    n_best are links whose pair is the most frequent of its A id, ties included; count_sum
    adds the documents that hold each link's pair. groups_sha256 digests `align`'s groups.
    """
    texts = id_and_text(docs, id_column, text_column)
    ranges = min(MOST_RANGES, max(LEAST_RANGES, text_bytes(texts) // range_text + 1))
    found = stored(texts.mapInArrow(_aligning(a_path, b_path, ranges), _FOUND), "alignments")
    blocks = found.filter("range is not null").select("chunk", "range", "block")
    pieces = len(Pieces(b_path).spelled)
    answers = blocks.groupBy("range").applyInArrow(_adding(pieces), "chunk string, range int, answer binary")
    documents = found.filter("range is null").select("chunk", "rows", "block")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return documents.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scoring, schema)
