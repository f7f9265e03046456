from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarium.llm import hard_negatives, queries

from .conftest import rows

SCHEMA = "vec_id long, label int, embedding array<double>, slice string, `group` int, `a.b` int, positives int"


def vectors(spark, given):
    return spark.createDataFrame([(*row, "s", 1, 2, 3) for row in given], SCHEMA)


def expected(given, is_anchor, positives=5, negatives=5, percent=80, scale=256):
    """Straight from the definition, in Python's whole numbers."""
    sound = {}
    for vec_id, label, vector in given:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (str(label), vector)
        sound[vec_id] = min(sound.get(vec_id, row), row)
    whole = {i: (label, [math.floor(scale * x) if abs(x) < 1e300 else scale * int(x) for x in v]) for i, (label, v) in sound.items()}
    found = []
    for anchor, (label, own) in whole.items():
        if not is_anchor(anchor):
            continue
        scores = {
            i: sum(a * b for a, b in zip(own, v, strict=True)) for i, (_, v) in whole.items() if i != anchor and len(v) == len(own)
        }
        scores = {i: s for i, s in scores.items() if -(1 << 63) <= s < 1 << 63}
        ranked = sorted(scores, key=lambda i: (-scores[i], i))
        for positive in [i for i in ranked if whole[i][0] == label][:positives]:
            p = scores[positive]
            hard = [i for i in ranked if whole[i][0] != label and percent * p <= 100 * scores[i] <= 100 * p]
            found += [(anchor, positive, n + 1, i, p, scores[i]) for n, i in enumerate(hard[:negatives])]
    return sorted(found, key=repr)


@pytest.mark.parametrize("sizes", ((2048, 1024), (7, 3)))
def test_equals_brute_force_in_any_grid(spark, sizes):
    rng = random.Random(3)
    given = [(i, i % 4, [rng.uniform(-1, 1) + 0.6 for _ in range(6)]) for i in range(120)]
    given += [(200 + i, i % 3, [0.5, 0.25, 0.5, 0.25, 0.5, 0.25]) for i in range(60)]  # one vector for a third of the rows
    found = hard_negatives.mine(vectors(spark, given), F.col("vec_id") % 10 == 0, slice_rows=sizes[0], group_rows=sizes[1])
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    want = expected(given, lambda i: i % 10 == 0)
    assert rows(found, *columns) == want and len(want) > 100


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    given = [
        (None, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 0, [0.5, 0.5]), (1, None, [1.0, 0.0]), (2, 1, None),
        (3, 1, [1.0, None]), (4, 1, [1.0, nan]), (5, 1, [-inf, 0.0]), (6, 0, [1.0, 1.0]), (7, 0, [0.9, 1.0]), (8, 1, [1.0, 0.9]),
        (9, 1, [0.9, 1.0]), (10, 0, [1.0, 1.0]), (11, 1, [1.0]), (20, 0, [1.0]), (21, 0, [2.0]), (22, 1, [1.9]),
        (30, 0, []), (31, 0, []), (32, 1, []), (40, 1, [-1.0, -1.0]),
    ]
    found = hard_negatives.mine(vectors(spark, given), F.col("vec_id") % 10 == 0)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert rows(found, *columns) == expected(given, lambda i: i % 10 == 0)
    assert rows(hard_negatives.mine(vectors(spark, given).limit(0), F.col("vec_id") % 10 == 0)) == []


def test_large_components_stay_exact(spark):
    given = [(i, i % 2, [float(3**i), -float(2**i), 1.0]) for i in range(20)] + [(100, 0, [1e308, 1.0, 0.0]), (101, 1, [1e-308, 2.0**40, 0.0])]
    found = hard_negatives.mine(vectors(spark, given), F.col("vec_id") % 5 == 0, percent=1)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    want = expected(given, lambda i: i % 5 == 0, percent=1)
    assert rows(found, *columns) == want and want


def test_one_product_holds_all_scores():
    rng = np.random.default_rng(1)
    for most in (3, 400, 1 << 20, 1 << 30):
        given = rng.integers(-most, most, (50, 8))
        packed = hard_negatives.Packed(given, most)
        for anchor in rng.integers(-most, most, (5, 8)).tolist():
            assert packed.scores(anchor).tolist() == [sum(a * b for a, b in zip(anchor, row, strict=True)) for row in given.tolist()]


def test_query(spark, small_folder):
    given = spark.read.parquet(f"{small_folder}/embeddings.parquet").collect()
    labelled = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in given]
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    found = rows(queries.op11_hard_negatives(spark, small_folder), *columns)
    assert found == expected(labelled, lambda i: i % 100 == 0) and found
