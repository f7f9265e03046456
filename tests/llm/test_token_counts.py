from __future__ import annotations

import hashlib

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from bazaarium.llm import queries, token_counts
from bazaarium.llm.common import new_path

from .conftest import rows

pytest.importorskip("public_tokenizers")
MODEL = queries.tokenizer("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
COUNTER = token_counts.PieceCounter(MODEL)

ODD = ["", " ", "  a", "a  b ", "x\ny", "\n\n", " \n x", "▁x ▁", "a\tb", "</s><s>", "漢字 é ﬁ", "\x00", "a" * 3000, "the " * 2000]


def test_word_by_word_counts_are_the_librarys():
    assert COUNTER.by_word
    counts = COUNTER.count(pa.array(ODD))
    assert counts.tolist() == [len(LIBRARY.encode(t)) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" ▁\n\tabe,.é漢ThHello", max_size=40), min_size=1, max_size=5))
def test_any_text_counts_as_the_library_counts_it(texts):
    assert COUNTER.count(pa.array(texts)).tolist() == [len(LIBRARY.encode(t)) for t in texts]


class Watched:
    """The library, with a note of each call: how many texts, how many threads."""

    def __init__(self):
        self.calls = []

    def encode(self, texts, num_threads=-1):
        self.calls.append((len(texts), num_threads))
        return LIBRARY.encode(texts, num_threads=num_threads)


@pytest.mark.parametrize("by_word", [True, False])
def test_few_pieces_are_held_at_a_time_and_by_one_thread(by_word):
    counter = token_counts.PieceCounter(MODEL)
    counter.library, counter.by_word = Watched(), by_word
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(2000)] + ["two  spaces"]
    assert counter.count(pa.array(texts)).tolist() == [len(ids) for ids in LIBRARY.encode(texts)]
    assert max(n for n, _ in counter.library.calls) <= 20_000
    assert {threads for _, threads in counter.library.calls} == {1}


def test_a_worker_remembers_words_of_bounded_memory():
    counter = token_counts.PieceCounter(MODEL)
    for start in range(0, 400_000, 50_000):
        counter.count(pa.array([" ".join(f"{i}" for i in range(start, start + 50_000))]))
        assert 0 < len(counter.known) <= 250_000


def test_nulls_copies_and_clashing_columns(docs):
    table = docs((1, "one two"), (1, "one two"), (2, None), (None, ""), (3, "one two"))
    found = rows(token_counts.count_tokens(table, MODEL), "doc_id", "n_bytes", "n_tokens")
    n = len(LIBRARY.encode("one two"))
    assert found == sorted([(1, 7, n), (1, 7, n), (2, 0, 0), (None, 0, 0), (3, 7, n)], key=repr)


def test_an_empty_table_gives_an_empty_result(docs):
    assert rows(token_counts.count_tokens(docs((1, "x")).limit(0), MODEL)) == []


def test_the_cache_is_appended_by_distinct_misses_only(spark, docs):
    path = new_path(spark, "cache")
    rows(token_counts.count_tokens(docs((1, "a b"), (2, "a b"), (3, "c")), MODEL, path))
    assert spark.read.parquet(path).count() == 2
    second = rows(token_counts.count_tokens(docs((4, "a b"), (5, "new text")), MODEL, path), "doc_id", "n_tokens")
    assert spark.read.parquet(path).count() == 3
    assert second == [(4, len(LIBRARY.encode("a b"))), (5, len(LIBRARY.encode("new text")))]


def test_files_of_the_cache_follow_its_rows_not_the_texts(spark, docs):
    path, usual = new_path(spark, "cache"), "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(usual)
    spark.conf.set(usual, "32k")
    try:
        texts = [" ".join(hashlib.sha256(f"{i} {j}".encode()).hexdigest() for j in range(300)) for i in range(80)]
        found = rows(token_counts.count_tokens(docs(*enumerate(texts)), MODEL, path), "doc_id", "n_tokens")
    finally:
        spark.conf.set(usual, before)
    assert found == sorted(((i, len(LIBRARY.encode(text))) for i, text in enumerate(texts)), key=repr)
    assert len(spark.read.parquet(path).inputFiles()) == 1


def test_counts_of_the_cache_are_used(spark, docs):
    path = new_path(spark, "cache")
    version = token_counts.tokenizer_digest(MODEL)
    rows(token_counts.count_tokens(docs((1, "a b")), MODEL, path))
    stored = spark.read.parquet(path)
    planted = new_path(spark, "cache")
    stored.selectExpr("digest", "version", "cast(99 as long) as n_tokens").write.parquet(planted)
    assert rows(token_counts.count_tokens(docs((1, "a b")), MODEL, planted), "n_tokens") == [(99,)]
    other = new_path(spark, "cache")
    stored.selectExpr("digest", f"'not {version}' as version", "cast(99 as long) as n_tokens").write.parquet(other)
    assert rows(token_counts.count_tokens(docs((1, "a b")), MODEL, other), "n_tokens") == [(len(LIBRARY.encode("a b")),)]


def test_the_query_counts_every_document(spark, small_folder):
    found = {r["doc_id"]: r for r in queries.op1_token_counts(spark, small_folder).collect()}
    for row in queries.documents(spark, small_folder).collect():
        n = len(LIBRARY.encode(row["text"] or ""))
        held = found.pop(row["doc_id"])
        assert (held["n_tokens"], held["n_bytes"], held["over_limit"]) == (n, len((row["text"] or "").encode()), n > 4096)
    assert not found
