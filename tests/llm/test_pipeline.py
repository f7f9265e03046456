from __future__ import annotations

from collections import Counter

import corpus_pipeline
from bazaarium.llm import queries, repetition, secret_ledger

from .conftest import rows
from .test_config_packing import check
from .test_sketch_dedup import expected as near

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def _expected(table: list[tuple]) -> list[tuple]:
    """The texts that reach the last stage, stage by stage by brute force."""
    table = [r for r in table if repetition.measure_text((r[1] or "").encode()).kept]
    best: dict[str, int] = {}
    for doc_id, text in table:
        best[text] = max(doc_id, best.get(text, doc_id))
    table = [(doc_id, text) for text, doc_id in best.items()]
    kept = {doc_id for doc_id, _, _, stays in near(table, 5) if stays}
    compiled = secret_ledger._compiled(secret_ledger.RULES)
    return [
        (doc_id, secret_ledger.redacted(text, secret_ledger.joined(secret_ledger.find_spans(text, compiled))))
        for doc_id, text in table
        if doc_id in kept
    ]


def test_the_pipeline_is_its_stages_by_brute_force(spark, small_folder):
    documents = queries.documents(spark, small_folder)
    table = _expected([(r["doc_id"], r["text"]) for r in documents.collect()])
    check(rows(corpus_pipeline.run(spark, small_folder)), table, 4096)


def test_stages_but_the_last_keep_the_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    made = [(1, text, "en", "s", len(text)), (2, text, "en", "s", len(text)), (3, None, None, None, None)]
    made.append((4, f"{text} password: hunter2hunter2", "en", "s", len(text) + 25))
    made.append((5, " ".join(f"v{i}" for i in range(80)) + " password: hunter2hunter2", None, "s", 1))
    documents = spark.createDataFrame(made, DOCUMENTS)
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        documents = stage(spark, documents, "")
        assert documents.columns == [c.split()[0] for c in DOCUMENTS.split(", ")]
        seen.append(sorted(r["doc_id"] for r in documents.collect()))
    assert seen == [[1, 2, 4, 5], [2, 4, 5], [2, 5], [2, 5]]
    last = {r["doc_id"]: r for r in documents.collect()}
    assert last[5]["text"].endswith("[assign]") and last[5]["n_chars"] == len(last[5]["text"])


def test_stages_take_empty_tables(spark):
    documents = spark.createDataFrame([], DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents, "").count() == 0


def test_the_stages_are_named_once():
    assert max(Counter(name for name, _ in corpus_pipeline.STAGES).values()) == 1 and len(corpus_pipeline.STAGES) == 5
