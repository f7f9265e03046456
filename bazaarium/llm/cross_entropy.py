"""Language-model scores by cross-entropy difference (operator 8).

`score_words` is what the query runs. Two models over one vocabulary, the distinct pairs of
neighbouring words of the whole corpus: the background on all documents, the target on
those that are marked good. A pair has the background chance b = (count + 1) / (tokens +
vocabulary + 1), where the last 1 is for pairs that the corpus lacks, and the target chance
(count + tokens * b) / (2 * tokens) with the target's own count and tokens. Smoothed by
add-one alone, the target, which has seen fewer tokens, would find every unseen pair likelier
than the background does, and junk would score as good. A document's score is its mean loss
per pair under the target minus that under the
background; the lower, the more it resembles the target. Words are runs of characters
other than ASCII white space, in ASCII lower case; a mark stands before each text, so
there are as many pairs as words. Pairs are told apart by 64-bit hashes.

Vocabulary and counts grow with the corpus and never leave the executors. Documents are
dealt into chunks. A chunk adds up its pairs and sends each range of pairs one block, sorted; a
range adds up all chunks and answers each block row for row with the counts of the corpus,
from which the chunk scores its documents. The text is shuffled once and both of a chunk's
steps read that shuffle. A pair that every document holds is one row for each chunk, so no
pair is hot. Chunks go by id, so that marks reach them without moving text; an id with more
than HOT_ROWS rows, and null ids, go by text, and such an id's mark goes to every chunk. A text of any length
is scored whole.

`score` is the small sibling over bytes: trigrams over a closed vocabulary of 256 values.
Counts are taken over the whole corpus. Each task adds up its own, so what travels is a
row for each trigram and task. The vocabulary bounds the model whatever the corpus: at
most 256^3 cells can occur, and workers are sent the counts of those that do, from which
each makes its two tables of 4-byte losses, 128 MiB in all.

Losses are interpolated by Witten and Bell: an order trusts its own counts as far as its
context was followed by the same few tokens, and the next lower order for the rest, down
to add-one counts of single tokens. Two zero bytes stand before each text. An empty or
null text has no tokens and its losses and score are null. A document that is marked in
any label row is target; no marked document makes the target uniform over bytes, and over
pairs of words the background. Repeated rows and
null ids count row by row. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarium.llm.blocks import pack, range_bounds, steps, text_bytes, unpack
from bazaarium.llm.common import CHUNK_BYTES, chunks, id_and_text

VOCABULARY = 256
_CELLS = VOCABULARY**3
#: Tokens after which a task hands its counts on, so that 32 bits hold any of them.
_FLUSH = 1 << 30
#: Rows of one id beyond which they are spread over chunks; such ids that are broadcast, beyond which they are joined by shuffle.
HOT_ROWS, MOST_BROADCAST = 1_000, 10_000
#: Text bytes of a chunk of documents, and of the corpus for each range of pairs.
CHUNK_TEXT, RANGE_TEXT = 4 << 20, 8 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each token, text after text, and where each text's tokens begin and end."""
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    padded = np.zeros(int(ends[-1]) + 2 * len(sizes), np.int32)
    inside = np.arange(int(ends[-1])) + np.repeat(2 * np.arange(1, len(sizes) + 1), sizes)
    padded[inside] = np.frombuffer(b"".join(t.as_buffer().to_pybytes() for t in texts if t.is_valid), np.uint8)
    return (padded[inside - 2] << 16) | (padded[inside - 1] << 8) | padded[inside], ends


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, marked -> cell, background, target."""
    counts, held = None, 0

    def rows() -> pa.RecordBatch:
        cells = np.flatnonzero(counts[0])
        return pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int32()), *(pa.array(c[cells], pa.int64()) for c in counts)], ["cell", "background", "target"]
        )

    for batch in chunks(batches, 0, CHUNK_BYTES):
        if counts is None:
            counts = [np.zeros(_CELLS, np.uint32) for _ in range(2)]
        cells, ends = trigrams(batch.column(0))
        marked = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(ends))
        np.add.at(counts[0], cells, np.uint32(1))
        np.add.at(counts[1], cells[marked], np.uint32(1))
        held += len(cells)
        if held > _FLUSH:
            yield rows()
            counts, held = None, 0
    if counts is not None:
        yield rows()


def losses(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Minus the log of the smoothed probability of every cell, float32, from the cells that occur."""
    third, second, first = cells & 0xFF, (cells >> 8) & 0xFF, cells >> 16
    single = np.bincount(third, counts, VOCABULARY)
    unigram = (single + 1) / (single.sum() + VOCABULARY)
    table = np.zeros((VOCABULARY, VOCABULARY))
    np.add.at(table, (second, third), counts)
    kinds, total = (table > 0).sum(1, keepdims=True), table.sum(1, keepdims=True)
    bigram = np.where(total > 0, (table + kinds * unigram) / np.maximum(total + kinds, 1), unigram)
    context = (first * VOCABULARY + second).astype(np.int64)
    total = np.bincount(context, counts, VOCABULARY**2)
    kinds = np.bincount(context, counts > 0, VOCABULARY**2)
    # Cells that do not occur have only the share of the lower order.
    share = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0).reshape(VOCABULARY, VOCABULARY, 1)
    chance = (share * bigram[None, :, :]).astype(np.float32).ravel()
    seen = np.where(total > 0, total + kinds, 1)[context]
    chance[cells] += (counts / seen).astype(np.float32)
    return -np.log(chance)


_LOADED: dict[str, list[np.ndarray]] = {}


def _tables(model) -> list[np.ndarray]:
    """Losses under target and background; a worker keeps those of one model."""
    name, cells, *counts = model.value
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = [losses(cells.astype(np.int64), n.astype(np.float64)) for n in counts]
    return _LOADED[name]


def count_trigrams(docs: DataFrame, marked: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(cell, background, target) over all documents; marked has the target's ids in its first column."""
    ids = marked.select(marked[marked.columns[0]].cast("long").alias("marked_id")).distinct()
    texts = id_and_text(docs, id_column, text_column)
    # Shuffled at any size: nothing bounds the marked ids.
    rows = texts.join(ids.hint("merge"), texts.doc_id == ids.marked_id, "left").select("text", F.col("marked_id").isNotNull().alias("marked"))
    partial = rows.mapInArrow(_counting, "cell int, background long, target long")
    return partial.groupBy("cell").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def score(
    docs: DataFrame, marked: DataFrame, scored: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) of scored, or else of docs."""
    spark = docs.sparkSession
    found = count_trigrams(docs, marked, id_column, text_column).toArrow()  # at most 256^3 rows
    counts = [found[name].to_numpy().astype(np.uint64) for name in ("target", "background")]
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, found["cell"].to_numpy().astype(np.int32), *counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, CHUNK_BYTES):
            at, ends = trigrams(batch.column(1))
            sizes = np.diff(ends)
            means = []
            for table in _tables(model):
                sums = np.concatenate(([0.0], np.cumsum(table[at], dtype=np.float64)))
                means.append(np.diff(sums[ends]) / np.maximum(sizes, 1))
            empty = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    *(pa.array(m, mask=empty) for m in (*means, means[0] - means[1])),
                ],
                ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"],
            )

    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"
    return id_and_text(docs if scored is None else scored, id_column, text_column).mapInArrow(run, schema)


# --- pairs of words ---------------------------------------------------------------


def word_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the one before it, text after text, and which text it stands in."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    coded = parts.flatten().dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    each = hashes[coded.indices.to_numpy()] if len(coded) else hashes[:0]
    sizes = pc.list_value_length(parts).to_numpy()
    ends = np.cumsum(sizes)
    before = np.concatenate((np.zeros(1, np.uint64), each[:-1])) if len(each) else each
    before[(ends - sizes)[sizes > 0]] = 0  # the mark before each text
    mixed = (before ^ (before >> np.uint64(31))) * _FACTOR + each
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    pairs = (mixed ^ (mixed >> np.uint64(29))).view(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    # a text without words is split into one empty string
    real = each != np.uint64(xxhash.xxh3_64_intdigest(""))
    return pairs[real], of[real]


def _held(pairs: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (pair, text), ordered by pair, and how often each occurs."""
    order = np.lexsort((of, pairs))
    pairs, of = pairs[order], of[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    return pairs[first], of[first], np.diff(np.append(first, len(pairs)))


def _counting_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, marked -> pair, background, target, docs: one row for each pair of a slice."""
    for batch in chunks(batches, 0, 4 * CHUNK_BYTES):
        pairs, of, times = _held(*word_pairs(batch.column(0)))
        if not len(pairs):
            continue
        marked = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[of]
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        sums = [np.add.reduceat(x, first).astype(np.int64) for x in (times, times * marked, np.ones(len(pairs), np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[first]), *map(pa.array, sums)], ["pair", "background", "target", "docs"])


def count_pairs(docs: DataFrame, marked: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(pair, background, target, docs) over all documents; marked has the target's ids in its first column."""
    ids = marked.select(marked[marked.columns[0]].cast("long").alias("marked_id")).distinct()
    texts = id_and_text(docs, id_column, text_column)
    rows = texts.join(ids.hint("merge"), texts.doc_id == ids.marked_id, "left").select("text", F.col("marked_id").isNotNull().alias("marked"))
    partial = rows.mapInArrow(_counting_pairs, "pair long, background long, target long, docs long")
    return partial.groupBy("pair").agg(*(F.sum(n).alias(n) for n in ("background", "target", "docs")))


def _slice(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct pairs, sorted; which of them each token is; the text of each token; which texts are fitted to."""
    pairs, of = word_pairs(texts.column("text").combine_chunks())
    distinct, at = np.unique(pairs.view(np.uint64), return_inverse=True)
    return distinct, at, of, texts.column("fits").to_numpy().astype(bool)


def _sending_pairs(ranges: int):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, marks: pa.Table) -> pa.Table:
        """The chunk's pairs for each range, with its tokens of the background and of the target."""
        packed, held = [], np.zeros(0, np.int64)
        if texts.num_rows:
            distinct, at, of, fits = _slice(texts)
            marked = fits & pc.is_in(texts.column("doc_id"), value_set=marks.column("doc_id").combine_chunks()).to_numpy()
            counts = [np.bincount(at[which[of]], minlength=len(distinct)) for which in (fits, marked)]
            bounds = range_bounds(distinct, ranges)
            held = np.flatnonzero(np.diff(bounds))
            parts = (slice(bounds[r], bounds[r + 1]) for r in held.tolist())
            packed = [pack(steps(distinct[p]), counts[0][p], counts[1][p]) for p in parts]
        chunk = (texts if texts.num_rows else marks).column("chunk")[0].as_py()
        return pa.table({"range": held, "chunk": pa.array([chunk] * len(held), pa.int64()), "block": pa.array(packed, pa.binary())})

    return run


def _added(blocks: pa.Table) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Which pair each entry of each block is, the distinct pairs' first and the two sums of each."""
    read = [unpack(block.as_buffer()) for block in blocks.column("block")]
    distinct, at = np.unique(np.concatenate([np.cumsum(r[0]) for r in read]), return_inverse=True)
    sums = [np.zeros(len(distinct), np.int64) for _ in range(2)]
    for number, total in enumerate(sums, 1):
        np.add.at(total, at, np.concatenate([r[number] for r in read]).astype(np.int64))
    return np.split(at, np.cumsum([len(r[0]) for r in read])[:-1]), distinct, sums


def _adding_pairs(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
    entries, _, sums = _added(blocks)
    answers = [pack(*(total[at] for total in sums)) for at in entries]
    return blocks.select(["chunk", "range"]).append_column("answer", pa.array(answers, pa.binary()))


def _totals(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
    _, _, (background, target) = _added(blocks)
    return pa.table({"kinds": [int((background > 0).sum())], "background": [int(background.sum())], "target": [int(target.sum())]})


def _scoring_pairs(key: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
    wanted = texts.column("asked").to_numpy().astype(bool)
    distinct, at, of, _ = _slice(texts)
    means, n = [np.zeros(len(wanted))] * 2, np.bincount(of, minlength=len(wanted))
    if len(distinct):
        order = np.argsort(answers.column("range").to_numpy()).tolist()
        read = [unpack(answers.column("answer")[i].as_buffer()) for i in order]
        background, target = (np.concatenate([r[i] for r in read]).astype(np.float64) for i in range(2))
        total = answers.column("totals")[0].as_py()
        weight = max(total["target"] or 0, 1)  # of the background's chance in the target's, in tokens
        chance = (background + 1) / ((total["background"] or 0) + (total["kinds"] or 0) + 1)
        likely = (target + weight * chance) / ((total["target"] or 0) + weight)
        means = [np.bincount(of, -np.log(c)[at], len(wanted)) / np.maximum(n, 1) for c in (likely, chance)]
    found = pa.table(
        {"doc_id": texts.column("doc_id"), "n_tokens": pa.array(n, pa.int64())}
        | {
            name: pa.array(values, pa.float64(), mask=n == 0)
            for name, values in (("target_loss", means[0]), ("background_loss", means[1]), ("difference", means[0] - means[1]))
        }
    )
    return found.filter(pa.array(wanted))


def _dealt(rows: DataFrame, ids: DataFrame, chunks: int, hot: int):
    """Rows and marked ids by chunk. An id with more than `hot` rows is spread by text, and its mark goes to every chunk."""
    many = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter(F.col("rows") > hot)
    number = many.count()
    home = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("long")
    anywhere = F.pmod(F.xxhash64("text", F.spark_partition_id()), F.lit(chunks)).cast("long")
    spread, marks = F.col("doc_id").isNull(), ids.select("doc_id", home.alias("chunk"))
    if number:
        listed = many.select("doc_id", F.lit(True).alias("spread")).hint("broadcast" if number <= MOST_BROADCAST else "merge")
        rows = rows.join(listed, "doc_id", "left")
        spread = spread | F.coalesce("spread", F.lit(False))
        everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
        marks = marks.join(listed, "doc_id", "left_anti").union(ids.join(listed, "doc_id", "left_semi").select("doc_id", everywhere))
    dealt = rows.select(F.when(spread, anywhere).otherwise(home).alias("chunk"), "doc_id", "text", "fits", "asked")
    return dealt.groupBy("chunk"), marks.groupBy("chunk")


def score_words(
    docs: DataFrame,
    marked: DataFrame,
    scored: DataFrame | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    hot: int = HOT_ROWS,
    chunk_text: int = CHUNK_TEXT,
    range_text: int = RANGE_TEXT,
) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) of scored, or else of docs."""

    def given(table: DataFrame, fits: bool, asked: bool) -> DataFrame:
        return id_and_text(table, id_column, text_column).select("*", F.lit(fits).alias("fits"), F.lit(asked).alias("asked"))

    rows = given(docs, True, True) if scored is None else given(docs, True, False).union(given(scored, False, True))
    ids = marked.select(marked[marked.columns[0]].cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    total = text_bytes(rows)
    ranges = total // range_text + 1
    texts, marks = _dealt(rows, ids, total // chunk_text + 1, hot)
    sent = texts.cogroup(marks).applyInArrow(_sending_pairs(ranges), "range long, chunk long, block binary").groupBy("range")
    sums = [F.sum(n).alias(n) for n in ("kinds", "background", "target")]
    totals = sent.applyInArrow(_totals, "kinds long, background long, target long").agg(*sums)
    answers = sent.applyInArrow(_adding_pairs, "chunk long, range long, answer binary").withColumn(
        "totals", totals.select(F.struct("kinds", "background", "target")).scalar()
    )
    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"
    return texts.cogroup(answers.groupBy("chunk")).applyInArrow(_scoring_pairs, schema)
