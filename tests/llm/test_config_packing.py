from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bazaarium.llm import config_packing, queries

from .conftest import rows

pytest.importorskip("public_tokenizers")
PATH = queries.tokenizer("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
WORDS = config_packing.WordIds(PATH)


def ids_of(text: str | None) -> list[int]:
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=25), st.text(alphabet="aAé'sSt, .\ń\x1cİΣß9½<|endoftext|>", max_size=25)), min_size=1, max_size=4))
def test_ids_word_by_word_are_the_librarys(texts):
    ids, bounds = WORDS.encode(pa.array(texts))
    for text, low, high in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[low:high].tolist() == ids_of(text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1, max_size=12))
def test_a_plan_holds_every_piece_once_and_fits(histogram):
    plan = config_packing.plan_sequences(histogram, 50, rounds=20)
    held = Counter()
    for configuration, number in plan.items():
        assert number > 0 and sum(n * k for n, k in configuration) <= 50
        for n, k in configuration:
            held[n] += k * number
    assert held == Counter(histogram)


def test_the_knapsack_is_exact_where_demand_does_not_bind():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.choice(np.arange(3, 40), 6, replace=False).astype(np.int64)
        prices, demand = rng.random(6), np.full(6, 100.0)
        best = np.zeros(61)
        for room in range(1, 61):
            best[room] = max([best[room - 1]] + [best[room - n] + p for n, p in zip(lengths, prices, strict=True) if n <= room])
        chosen = dict(config_packing.knapsack(lengths, prices, demand, 60))
        worth = sum(prices[list(lengths).index(n)] * k for n, k in chosen.items())
        assert worth == pytest.approx(best[60])


def test_the_fractional_solution_covers_and_rounding_is_close_to_it():
    rng = np.random.default_rng(5)
    histogram = Counter(rng.integers(20, 900, 4000).tolist())
    used = config_packing.fractional_cover(dict(histogram), 1000, rounds=3000)
    for length, demand in histogram.items():
        assert sum(t * dict(c).get(length, 0) for c, t in used.items()) >= demand * 0.999
    bound = -(-sum(n * k for n, k in histogram.items()) // 1000)
    assert sum(config_packing.plan_sequences(histogram, 1000).values()) <= bound * 1.02


def test_the_program_places_most_pieces_at_production_parameters():
    rng = np.random.default_rng(7)
    lengths = np.minimum(rng.geometric(1 / 700, 60_000), 4096)
    histogram = dict(Counter(lengths[lengths % 3 == 0].tolist()))
    used = config_packing.fractional_cover(histogram, 4096)
    for length, demand in histogram.items():
        assert sum(t * dict(c).get(length, 0) for c, t in used.items()) >= demand * (1 - 2 * config_packing.TOLERANCE)
    plan, left = config_packing.rounded(used, histogram)
    pieces = sum(histogram.values())
    assert sum(left.values()) == pieces - sum(k * number for c, number in plan.items() for _, k in c) < 0.2 * pieces
    bound = -(-sum(n * k for n, k in histogram.items()) // 4096)
    assert sum(plan.values()) + sum(config_packing.best_fit(left, 4096).values()) <= bound + 1


def check(found: list[tuple], table: list[tuple], capacity: int) -> None:
    whole = Counter()
    for doc_id, text in table:
        ids = np.array([*ids_of(text), 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            whole[(doc_id, piece, start, len(own), zlib.crc32(own.tobytes()))] += 1
    assert Counter(r[:5] for r in found) == whole
    sequences: dict[int, list] = {}
    for r in found:
        sequences.setdefault(r[5], []).append((r[6], r[3]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity


def test_pieces_are_placed_without_gaps(docs):
    table = [(i % 90, " ".join(["word"] * (i * 7 % 60))) for i in range(150)] + [(None, None), (5, ""), (6, "x " * 500)]
    found = rows(config_packing.pack(docs(*table).repartition(5), PATH, capacity=64))
    check(found, table, 64)
    tokens = sum(r[3] for r in found)
    assert len({r[5] for r in found}) <= -(-tokens // 64) + 1


def test_an_empty_table_gives_an_empty_result(docs):
    assert rows(config_packing.pack(docs((1, "a")).limit(0), PATH)) == []


def test_the_query_holds_for_every_document(spark, small_folder):
    table = [(r["doc_id"], r["text"]) for r in queries.documents(spark, small_folder).collect()]
    found = rows(queries.op10_config_packing(spark, small_folder))
    check(found, table, 4096)
    assert len({r[5] for r in found}) == -(-sum(r[3] for r in found) // 4096)
