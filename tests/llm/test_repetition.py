from __future__ import annotations

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bazaarium.llm import queries, repetition

from .conftest import rows


def base(text: str) -> tuple:
    """The base measures, straight from their definitions."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    under = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(under) > 50 * len(words)
    return (len(words), sum(map(len, words)), symbols, dup, len(under), failed)


def share(text: str, n: int) -> int:
    """Characters of words under repeats of n-grams, first occurrences left out."""
    words, seen, under = re.findall(r"[^\x20\x09-\x0D]+", text), set(), set()
    for i in range(len(words) - n + 1):
        gram = tuple(words[i : i + n])
        if gram in seen:
            under.update(range(i, i + n))
        seen.add(gram)
    return sum(len(words[i]) for i in under)


def measured(text: str) -> tuple:
    m = repetition.measure_text(text.encode())
    return (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é漢", " x", "#", "\n", " ", "\x0b", "\x1c", " ", "a b a b\n"]), max_size=120).map(" ".join))
def test_base_measures_and_coverage_follow_their_definitions(text):
    assert measured(text) == base(text)
    m = repetition.measure_text(text.encode())
    assert list(m.dup_ngram_chars) == [share(text, n) for n, _ in repetition.Rules().ngram_shares]


def test_many_distinct_words_are_numbered_without_collision():
    text = " ".join(map(str, range(3000))) + " 1 2 3"
    assert measured(text)[4] == 6


def test_repetition_is_rejected_and_one_repeated_line_is_not():
    filler = " ".join(f"w{i}" for i in range(60))
    line = "this line of license text stands here and then there again"
    assert repetition.measure_text(f"{line}\n{filler}\n{line}".encode()).kept
    passage = " ".join(f"p{i}" for i in range(40))
    assert not repetition.measure_text(f"{passage} {filler} {passage} again {passage}".encode()).kept
    assert not repetition.measure_text(("short line here\n" * 40 + filler).encode()).kept


@pytest.mark.parametrize("place", range(6))
def test_each_ngram_rule_rejects_repeats_that_pass_the_base_rules(place):
    rules = repetition.Rules()
    n, limit = rules.ngram_shares[place][0], rules.ngram_passage_shares[place]
    words = 4000
    for share, kept in ((limit + 0.005, False), (limit - 0.005, True)):
        times = int(share * words / n)
        chunks = [" ".join(f"c{place}{i * n + k:04}" for k in range(n)) for i in range(times)]
        filler = iter(f"f{i:05}" for i in range(words))
        apart = [f"{chunk} {next(filler)}" for chunk in chunks * 2]
        rest = [next(filler) for _ in range(words - sum(len(a.split()) for a in apart))]
        m = repetition.measure_text(" ".join(apart + rest).encode())
        assert m.n_words == words and not m.base_failed and m.kept is kept
        assert m.dup_ngram_chars[place] == times * n * 6 and sum(m.dup_ngram_chars[place + 1 :]) == 0


def test_the_line_rule_rejects_lines_that_pass_all_other_rules():
    for copies, kept in ((27, False), (20, True)):
        lines = [line for i in range(copies) for line in (f"w{i:04} v{i:04}", "same1 line2")]
        lines += [f"x{i:04}" for i in range(240 - 4 * copies)]
        m = repetition.measure_text("\n".join(lines).encode())
        assert not m.base_failed and m.dup_ngram_chars[0] == 0 and m.kept is kept


def test_a_long_passage_that_stands_twice_is_rejected():
    passage, filler = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("p", 60), ("f", 200)))
    m = repetition.measure_text(f"{passage} {filler} {passage}".encode())
    assert not m.base_failed and not m.kept


def test_edges(docs):
    good = " ".join(f"w{i}" for i in range(80))
    table = docs((1, None), (2, ""), (None, good), (3, good), (3, good), (4, "x " * 30_000))
    found = rows(repetition.measure(table), "doc_id", "n_words", "kept")
    assert found == sorted([(1, 0, False), (2, 0, False), (None, 80, True), (3, 80, True), (3, 80, True), (4, 30_000, False)], key=repr)
    kept = repetition.keep_good(table)
    assert kept.columns == table.columns
    assert rows(kept, "doc_id") == sorted([(None,), (3,), (3,)], key=repr)
    assert rows(repetition.measure(table.limit(0))) == [] == rows(repetition.keep_good(table.limit(0)))


def test_the_query_holds_for_every_document(spark, small_folder):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = rows(queries.op2_repetition_rules(spark, small_folder), *names)
    table = queries.documents(spark, small_folder).collect()
    assert found == sorted([(r["doc_id"], *base(r["text"] or "")) for r in table], key=repr)
