"""Hard negatives by exact scores from Kronecker-packed products (operator 11).

A row's score is its whole-number inner product with an anchor. Components become
floor(scale * x). For a slice of candidates, each component of all of them is biased to be
non-negative and set into separated fields of one wide integer, so a slice has one integer
for each dimension. An anchor multiplies its component, biased as well, into each and adds
up: one product for a component of all candidates. Fields are wide enough that no sum
reaches the next one; the scores are read off the bytes, and the biases are taken out:
(a + p)(c + q) - q * sum(a) - p * sum(c) - d * p * q.

Positives of an anchor are its first `positives` other rows of the same label; for each of
them, negatives are the first `negatives` rows of another label whose score is at least
`percent` hundredths of the positive's and at most the positive's. Higher scores come first,
ties by smaller id. Everything is a whole number, so nothing is rounded.

The anchors are a query set against all rows, in blocks: groups of anchors meet slices of
candidates in the cells of a grid, each cell joined by its key. Cells have a fixed size, so
no task grows with the table, whatever labels or vectors repeat; each hands on at most the
first few rows of each anchor, and windows keep the first of those. Equal vectors are just ties.

Rows with a null id, label or vector, or with a component that is null or not finite, take
no part. Of several rows with one id, the one with the smallest (label, vector) does.
Vectors are scored against those of their own length only; empty ones score 0. Scores that
a 64-bit number cannot hold, from components beyond about 2^26, are left out. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarium.llm.common import column, stored

#: Rows of a cell of the grid.
SLICE, GROUP = 2048, 1024


class Packed:
    """A slice of candidates as one wide integer for each dimension."""

    def __init__(self, rows: np.ndarray, largest: int):
        """rows: one candidate's components each, whole numbers; largest: no anchor's component is beyond it."""
        self.n, self.dimensions = rows.shape
        own = [int(x) for x in rows.ravel()] if rows.dtype == object else None
        most = max(map(abs, own), default=0) if own is not None else int(np.abs(rows).max(initial=0))
        self.bias, self.anchor_bias = most, largest
        bits = max(1, (2 * most * 2 * largest * max(1, self.dimensions)).bit_length())
        self.width = 4 if bits <= 32 else 8 if bits <= 64 else -(-bits // 8)
        lifted = rows + self.bias
        self.sums = rows.sum(axis=1) if self.dimensions else np.zeros(self.n, np.int64)
        self.fields = [self._field(lifted[:, d]) for d in range(self.dimensions)]

    def _field(self, values: np.ndarray) -> int:
        if self.width <= 8:
            return int.from_bytes(values.astype(f"<u{self.width}").tobytes(), "little")
        return int.from_bytes(b"".join(int(v).to_bytes(self.width, "little") for v in values), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Of all candidates; objects where 64 bits may not do."""
        p, q = self.anchor_bias, self.bias
        product = sum(map(mul, [a + p for a in anchor], self.fields))
        data = product.to_bytes(self.n * self.width, "little")
        taken = q * sum(anchor) + self.dimensions * p * q
        if self.width <= 8:
            read = np.frombuffer(data, f"<u{self.width}").astype(np.int64)
            return read - p * self.sums.astype(np.int64) - taken
        w = self.width
        fields = (int.from_bytes(data[i * w : (i + 1) * w], "little") for i in range(self.n))
        return np.array([f - p * int(s) - taken for f, s in zip(fields, self.sums, strict=True)], object)


def whole_components(vectors: pa.Array, scale: int, n: int) -> np.ndarray:
    """floor(scale * x) of every component, as 64-bit numbers where all are small, else as objects."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * flat)
    beyond = ~np.isfinite(scaled)
    if beyond.any() or np.abs(scaled).max(initial=0) >= 1 << 31:
        whole = np.array([scale * int(x) if b else int(s) for x, s, b in zip(flat, scaled, beyond, strict=True)], object)
    else:
        whole = scaled.astype(np.int64)
    return whole.reshape(n, -1)


_LONG = 1 << 63


def _first(ids: np.ndarray, scores: np.ndarray, some: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n highest scores among some, ties by smaller id."""
    at = np.flatnonzero(some)
    if len(at) > n:
        found = scores[at]
        at = at[found >= (np.partition(found, -n)[-n] if found.dtype != object else sorted(found)[-n])]
    return np.array(sorted(at.tolist(), key=lambda i: (-int(scores[i]), int(ids[i])))[:n] if len(at) <= 64 else at[np.lexsort((ids[at], -scores[at]))][:n], np.int64)


def _cell(candidates: pa.Table, anchors: pa.Table, scale: int):
    """ids, labels, and for each anchor its position and scores."""
    ids = candidates.column("vec_id").to_numpy()
    rows = whole_components(candidates.column("vector").combine_chunks(), scale, len(ids))
    own = whole_components(anchors.column("vector").combine_chunks(), scale, anchors.num_rows).tolist()
    largest = max((abs(x) for anchor in own for x in anchor), default=0)
    packed = Packed(rows, largest)
    for number, anchor in enumerate(own):
        scores = packed.scores(anchor)
        fits = np.ones(len(ids), bool) if scores.dtype != object else np.array([-_LONG <= s < _LONG for s in scores], bool)
        yield number, ids, scores, fits


def _labels(candidates: pa.Table, anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    both = pa.concat_arrays([t.column("label").combine_chunks() for t in (candidates, anchors)])
    codes = both.dictionary_encode().indices.to_numpy()
    return codes[: candidates.num_rows], codes[candidates.num_rows :]


def _table(found: list[tuple], names: list[str]) -> pa.Table:
    return pa.table({name: pa.array([row[i] for row in found], pa.int64()) for i, name in enumerate(names)})


def _positives(scale: int, n: int):
    def run(key: tuple[pa.Scalar, ...], candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if candidates.num_rows and anchors.num_rows:
            labels, of_anchor = _labels(candidates, anchors)
            anchor_ids = anchors.column("vec_id").to_pylist()
            for number, ids, scores, fits in _cell(candidates, anchors, scale):
                some = fits & (labels == of_anchor[number]) & (ids != anchor_ids[number])
                found += [(anchor_ids[number], int(ids[i]), int(scores[i])) for i in _first(ids, scores, some, n)]
        return _table(found, ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(scale: int, n: int, percent: int):
    def run(key: tuple[pa.Scalar, ...], candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if candidates.num_rows and anchors.num_rows:
            labels, of_anchor = _labels(candidates, anchors)
            anchor_ids, wanted = anchors.column("vec_id").to_pylist(), anchors.column("positives").to_pylist()
            for number, ids, scores, fits in _cell(candidates, anchors, scale):
                others = fits & (labels != of_anchor[number])
                for positive in wanted[number]:
                    score = positive["positive_score"]
                    least = -(-percent * score // 100)
                    some = others & (scores <= score) & (scores >= least) if least <= score else ~fits & fits
                    found += [
                        (anchor_ids[number], positive["positive_id"], score, int(ids[i]), int(scores[i]))
                        for i in _first(ids, scores, some, n)
                    ]
        return _table(found, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _gridded(candidates: DataFrame, anchors: DataFrame, slices: int, groups: int):
    """Candidates and anchors of each cell, grouped alike."""
    key = F.xxhash64("vec_id")
    one = candidates.select(
        F.pmod(key, F.lit(slices)).cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        *candidates.columns,
    )
    other = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
        F.pmod(key, F.lit(groups)).cast("int").alias("group"),
        *anchors.columns,
    )
    cell = ["dimensions", "group", "slice"]
    return one.groupBy(*cell).cogroup(other.groupBy(*cell))


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
    slice_rows: int = SLICE,
    group_rows: int = GROUP,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); is_anchor is over the column vec_id."""
    given = vectors.select(
        column(id_column).cast("long").alias("vec_id"),
        column(label_column).cast("string").alias("label"),
        column(vector_column).cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    sound = given.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    one = sound.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    rows = stored(one.select("vec_id", "row.label", "row.vector", F.size("row.vector").alias("dimensions")), "vectors")
    anchors = rows.filter(is_anchor)
    sizes = rows.agg(F.count("*").alias("rows"), F.count_if(is_anchor).alias("anchors")).first()
    slices, groups = sizes["rows"] // slice_rows + 1, sizes["anchors"] // group_rows + 1

    near = _gridded(rows, anchors, slices, groups).applyInArrow(
        _positives(scale, positives), "anchor_id long, positive_id long, positive_score long"
    )
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    wanted = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")
    )
    asked = stored(anchors.join(wanted, "vec_id"), "anchors")
    found = _gridded(rows, asked, slices, groups).applyInArrow(
        _negatives(scale, negatives, percent),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    hardest = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(hardest)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
