"""Packing documents into sequences by a configuration linear program (operator 10).

A configuration is a multiset of lengths that fits into one sequence. The least number
of sequences that holds a histogram of lengths is a covering program over
configurations: one variable for each, one constraint for each length. Multiplicative
weights solve it. Each length has a price that falls as its demand gets covered, the
next configurations are those of highest price that fit, within a small tolerance (an
unbounded knapsack, by dynamic programming over the capacity), and each enters with a
step that covers a fixed share of the demand that it covers first, until every length is
covered. The fractional solution is rounded to whole sequences as far as demand allows,
and only what rounding leaves over is placed best-fit.

All of that works on the histogram, which has at most one entry for each length up to
the capacity, so the driver's work does not depend on the number of documents. Counting
lengths, ranking pieces among those of equal length and giving each piece its place are
Spark jobs; a rank is a prefix sum over partitions, so a length that a third of all
pieces have is no hot key.

Null texts count as empty. Every document ends with the end token, so an empty one is
one token long. Only a document longer than a sequence is cut. Repeated rows and null
ids are packed like any other row; an empty table gives an empty result; columns
besides id and text are ignored.
"""

from __future__ import annotations

import os
import string
import zlib
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from operator import neg

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarium.llm.common import CHUNK_BYTES, chunks, id_and_text, stored

#: The share of a length's demand that may stay uncovered: no more than floating point needs.
TOLERANCE = 1e-6
#: A configuration enters at a price that is lower than the highest by this share at most.
SLACK = 0.05
#: The share of a length's demand that one step covers, and how fast its price falls.
STEP, FALL = 0.25, 2.0
#: Distinct words whose ids a worker remembers; beyond it, it starts afresh.
REMEMBERED_WORDS = 500_000
_LONGEST_REMEMBERED = 64

Configuration = tuple[tuple[int, int], ...]
"""(length, how often), longest first."""


# --- histogram to plan ------------------------------------------------------------


def knapsack_table(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to the capacity, the highest price that fits and a length that reaches it, or 0."""
    worth = np.full(capacity + 1, -np.inf)
    worth[lengths] = prices
    best = np.zeros(capacity + 1)
    chosen = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        reached = worth[1 : room + 1] + best[room - 1 :: -1]
        length = int(reached.argmax()) + 1
        if reached[length - 1] > best[room - 1]:
            best[room], chosen[room] = reached[length - 1], length
        else:
            best[room] = best[room - 1]
    return best, chosen


def _traced(chosen: list[int], demand: dict[int, float], descending: list[int], capacity: int, first: int = 0) -> Configuration:
    """The table's multiset for the capacity, or for what `first` leaves of it; no length beyond its demand."""
    room, taken = capacity, Counter()
    if first:
        taken[first], room = 1, capacity - first
    while room > 0:
        length = chosen[room]
        if not length:
            room -= 1
            continue
        if demand[length] - taken[length] < 1:  # the table knows no demand: the longest that fits and is wanted stands in
            at = bisect_left(descending, -room, key=neg)
            length = next((n for n in islice(descending, at, None) if demand[n] - taken[n] >= 1), 0)
            if not length:
                break
        taken[length] += 1
        room -= length
    return tuple(sorted(taken.items(), reverse=True))


def knapsack(lengths: np.ndarray, prices: np.ndarray, demand: np.ndarray, capacity: int) -> Configuration:
    """The multiset of highest price that fits; no length occurs more often than it is in demand."""
    _, chosen = knapsack_table(lengths, prices, capacity)
    wanted = dict(zip(lengths.tolist(), demand.tolist(), strict=True))
    return _traced(chosen.tolist(), wanted, sorted(wanted, reverse=True), capacity)


def fractional_cover(histogram: dict[int, int], capacity: int, rounds: int | None = None) -> dict[Configuration, float]:
    """Multiplicative weights: how often each configuration is used, in fractions.

    Goes on until every length is covered up to TOLERANCE; `rounds`, if given, ends it after
    so many knapsack tables. Each step covers a share STEP of some length's demand or all
    that was left of it, so there are at most 1 + 1 / STEP steps for each length.
    """
    lengths = np.array(sorted(histogram, reverse=True), np.int64)
    demand = np.array([histogram[n] for n in lengths.tolist()], np.float64)
    place = {n: i for i, n in enumerate(lengths.tolist())}
    covered = np.zeros(len(lengths))
    used: dict[Configuration, float] = defaultdict(float)
    # A length's own share of a sequence is its fair price; longer ones, harder to place, cost more.
    fair = lengths / capacity * (1 + 0.05 * lengths / capacity)
    number = 0
    while rounds is None or number < rounds:
        number += 1
        open_ = covered < 1 - TOLERANCE
        if not open_.any():
            break
        prices = fair * np.exp(-FALL * covered)
        best, chosen = knapsack_table(lengths[open_], prices[open_], capacity)
        steps, wanted = chosen.tolist(), dict(zip(lengths[open_].tolist(), demand[open_].tolist(), strict=True))
        descending = list(wanted)
        # One table prices many configurations: the best one through each length, dearest first.
        through = prices[open_] + best[capacity - lengths[open_]]
        least = (1 - SLACK) * best[capacity]
        for nth, at in enumerate(np.argsort(-through, kind="stable").tolist()):
            if through[at] < least:
                break
            configuration = _traced(steps, wanted, descending, capacity, descending[at])
            rows = np.array([place[n] for n, _ in configuration])
            times = np.array([k for _, k in configuration], np.float64)
            # Prices have fallen since the table was made; what is still dear enough enters.
            if nth and ((covered[rows] >= 1 - TOLERANCE).any() or fair[rows] * np.exp(-FALL * covered[rows]) @ times < least):
                continue
            step = float(np.min(demand[rows] / times)) * STEP
            step = min(max(step, 1.0), float(np.min(np.ceil(demand[rows] * (1 - covered[rows]) / times - TOLERANCE))))
            used[configuration] += step
            covered[rows] += step * times / demand[rows]
    return used


def best_fit(left: dict[int, int], capacity: int) -> Counter[Configuration]:
    """Best-fit decreasing on counts: sequences that hold the same lengths are one entry."""
    groups: dict[int, Counter[Configuration]] = defaultdict(Counter)  # by the room that is left
    for length in sorted(left, reverse=True):
        count = left[length]
        for room in sorted(r for r in groups if r >= length):
            each = room // length
            for held in list(groups[room]):
                if not count:
                    break
                number = groups[room].pop(held)
                full = min(number, count // each)
                if full:
                    groups[room - each * length][(*held, (length, each))] += full
                    count -= full * each
                if full < number and count and count < each:
                    groups[room - count * length][(*held, (length, count))] += 1
                    full, count = full + 1, 0
                if full < number:
                    groups[room][held] += number - full
            if not groups[room]:
                del groups[room]
            if not count:
                break
        each = capacity // length
        if count // each:
            groups[capacity - each * length][((length, each),)] += count // each
        if count % each:
            groups[capacity - count % each * length][((length, count % each),)] += 1
    total: Counter[Configuration] = Counter()
    for held in groups.values():
        total.update(held)
    return total


def rounded(used: dict[Configuration, float], histogram: dict[int, int]) -> tuple[Counter[Configuration], dict[int, int]]:
    """Whole sequences of the fractional solution, and the pieces that rounding leaves over."""
    left, plan = Counter(histogram), Counter()
    for upward in (False, True):  # whole parts first, then what rounding up still finds in demand
        for configuration, times in sorted(used.items(), key=lambda x: -x[1]):
            wanted = int(times) if not upward else 1
            number = min(wanted, *(left[n] // k for n, k in configuration))
            if number:
                plan[configuration] += number
                for n, k in configuration:
                    left[n] -= number * k
    return plan, {n: k for n, k in left.items() if k}


def plan_sequences(histogram: dict[int, int], capacity: int, rounds: int | None = None) -> Counter[Configuration]:
    """Whole sequences for every piece: configuration -> how many sequences use it."""
    wanted = {n: k for n, k in histogram.items() if k}
    if not wanted:
        return Counter()
    if max(wanted) > capacity or min(wanted) < 1:
        raise ValueError("lengths must lie between 1 and the capacity")
    plan, left = rounded(fractional_cover(wanted, capacity, rounds), wanted)
    plan.update(best_fit(left, capacity))
    return plan


@dataclass(frozen=True)
class Places:
    """For each length, runs of ranks: who comes into which sequences, and where."""

    keys: np.ndarray  # length << 40 | first rank
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (lengths << 40) | ranks, "right") - 1
        nth = ranks - (self.keys[at] & ((1 << 40) - 1))
        each = self.each[at]
        return self.sequence[at] + nth // each, self.offset[at] + nth % each * lengths


def places(plan: Counter[Configuration]) -> Places:
    runs, next_rank, sequence = [], Counter(), 0
    for configuration, number in sorted(plan.items()):
        offset = 0
        for length, each in configuration:
            runs.append(((length << 40) | next_rank[length], sequence, each, offset))
            next_rank[length] += number * each
            offset += length * each
        sequence += number
    runs.sort()
    return Places(*(np.array([run[i] for run in runs], np.int64) for i in range(4)))


# --- texts to ids -----------------------------------------------------------------


class WordIds:
    """Ids of texts, word by word.

    The tokenizer drops white space and lets no token cross it, so a text's ids are those
    of its words in turn. Words of letters alone, with ASCII punctuation after them or
    not, part at that punctuation too and go straight to the tokenizer's BPE model in
    lower case; all others go through its whole chain.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.shown = _byte_characters()

    def _chain(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _model(self, letters: str) -> bytes:
        """Lower-case letters alone."""
        ids = self.known.get(letters)
        if ids is None:
            shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.shown)
            ids = array("I", [token.id for token in self.model.tokenize(shown)]).tobytes()
            if len(letters) <= _LONGEST_REMEMBERED:
                self.known[letters] = ids
        return ids

    def word(self, word: str) -> bytes:
        """The ids of a word that is not remembered yet."""
        letters = word.rstrip(string.punctuation)
        if not letters or not _PLAIN.issuperset(letters):
            ids = self._chain(word)
        elif len(letters) == len(word):
            ids = self._model(letters.lower())
        else:
            end = word[len(letters) :]
            ids = self._model(letters.lower()) + (self.known.get(end) or self.known.setdefault(end, self._chain(end)))
        if len(word) <= _LONGEST_REMEMBERED:
            self.known[word] = ids
        return ids

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin and end."""
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        parts = pc.ascii_split_whitespace(texts)
        words = parts.flatten().dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [ids if ids is not None else self.word(w) for w, ids in zip(distinct, map(self.known.get, distinct), strict=True)]
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[np.repeat(first[codes] - ends[:-1], lengths) + np.arange(ends[-1])] if len(codes) else flat[:0]
        return ids, ends[np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy())))]


#: Letters that are the same by themselves as in any text, and whose lower case is one letter.
_PLAIN = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1)


def _byte_characters() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _pieces(path: str, end_id: int, capacity: int):
    """doc_id, piece, start, length, ids_crc32, part, nth (among the part's pieces of that length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = _word_ids(path), Counter(), TaskContext.get().partitionId()
        for batch in chunks(batches, 1, 2 * CHUNK_BYTES):
            ids, bounds = words.encode(batch.column(1))
            rows = []
            for doc_id, low, high in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.append(ids[low:high], np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    held = own[start : start + capacity]
                    rows.append((doc_id, piece, start, len(held), zlib.crc32(held.tobytes()), part, seen[len(held)]))
                    seen[len(held)] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int32() if i == 1 else pa.int64()) for i, column in enumerate(zip(*rows, strict=True))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return run


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


def _placing(found: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sequence, offset = found.find(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    rounds: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece."""
    if capacity < 1:
        raise ValueError("a sequence holds at least one token")
    texts = id_and_text(docs, id_column, text_column)
    # Stored, so that a piece keeps its rank whatever is computed again later.
    pieces = stored(texts.mapInArrow(_pieces(tokenizer_path, end_id, capacity), _PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    # At most one row for each length up to the capacity.
    histogram = {row["length"]: row["rows"] for row in counts.groupBy("length").agg(F.sum("rows").alias("rows")).collect()}
    found = places(plan_sequences(histogram, capacity, rounds))
    ranked = pieces.join(bases, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_placing(found), schema)
