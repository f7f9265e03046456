from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bazaarium.llm import cross_entropy, queries

from .conftest import rows


class Model:
    """Witten-Bell trigrams over bytes, straight from the definition."""

    def __init__(self, texts):
        self.counts = [defaultdict(Counter) for _ in range(3)]
        for text in texts:
            padded = b"\0\0" + text.encode()
            for i in range(2, len(padded)):
                for order in range(3):
                    self.counts[order][padded[i - order : i]][padded[i]] += 1

    def chance(self, context: bytes, token: int) -> float:
        held = self.counts[len(context)][context]
        total, kinds = sum(held.values()), len(held)
        if not context:
            return (held[token] + 1) / (total + 256)
        lower = self.chance(context[1:], token)
        return (held[token] + kinds * lower) / (total + kinds) if total else lower

    def loss(self, text: str) -> float:
        padded = b"\0\0" + text.encode()
        return -sum(math.log(self.chance(padded[i - 2 : i], padded[i])) for i in range(2, len(padded))) / (len(padded) - 2)


def test_losses_follow_the_definition(spark, docs):
    table = [(1, "abc abd é"), (2, "zzzz \x00 漢"), (3, None), (None, ""), (4, "abc"), (4, "abc"), (5, "q" * 50_000)]
    marked = spark.createDataFrame([(1, "x"), (1, "x"), (4, "y"), (99, "z"), (None, "n")], "id long, text string")
    found = cross_entropy.score(docs(*table), marked)
    target = Model([t for i, t in table if i in (1, 4)])
    background = Model([t or "" for _, t in table])
    scored = {}
    for doc_id, n, a, b, difference in rows(found):
        scored.setdefault(doc_id, (n, a, b, difference))
    assert found.count() == len(table)
    for doc_id, text in table:
        n, a, b, difference = scored[doc_id]
        assert n == len((text or "").encode())
        if not text:
            assert (a, b, difference) == (None, None, None)
        else:
            assert a == pytest.approx(target.loss(text), rel=1e-5)
            assert b == pytest.approx(background.loss(text), rel=1e-5)
            assert difference == pytest.approx(a - b, abs=1e-9)


def test_edges(spark, docs):
    none = spark.createDataFrame([], "id long")
    assert rows(cross_entropy.score(docs((1, "a")).limit(0), none)) == []
    ((_, n, a, b, _),) = rows(cross_entropy.score(docs((1, "abc")), none))
    assert n == 3 and a == pytest.approx(math.log(256)) and b < a


def test_counts_are_taken_over_all_documents(spark, small_folder):
    table = queries.documents(spark, small_folder)
    counts = cross_entropy.count_trigrams(table, table.select("doc_id"))
    total = table.agg(F.sum(F.octet_length("text"))).scalar()
    assert counts.agg(F.sum("background"), F.sum("target")).first() == (table.sparkSession.range(1).select(total).first()[0],) * 2


def test_held_out_documents_of_good_quality_score_lower(spark, small_folder):
    folder = small_folder.replace("sf0.001", "sf0.01")
    table, labels = queries.documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    fit = table.filter("doc_id % 2 = 0")
    held_out = table.filter("doc_id % 2 = 1")
    marked = labels.filter("quality = 1").select("doc_id")
    scored = cross_entropy.score(fit, marked, held_out).join(labels, "doc_id").select("quality", "difference").collect()
    good, bad = ([r[1] for r in scored if r[0] == q and r[1] is not None] for q in (1, 0))
    ordered = sum(a < b for a in good for b in bad) / (len(good) * len(bad))
    assert ordered > 0.9


def pairs_of(text: str | None) -> list[tuple[str, str]]:
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return list(zip(["", *words], words, strict=False))


def scores_by_pairs(table, marked, scored):
    """Sorted (doc_id, n_tokens, target_loss, background_loss, difference), straight from the definition."""
    background, target = (Counter(p for i, t in table if i in ids for p in pairs_of(t)) for ids in ({i for i, _ in table}, set(marked) - {None}))
    n_target, n_background = sum(target.values()), sum(background.values())
    weight = max(n_target, 1)
    expected = []
    for doc_id, text in scored:
        own = pairs_of(text)
        b = {p: (background[p] + 1) / (n_background + len(background) + 1) for p in own}
        t = {p: (target[p] + weight * b[p]) / (n_target + weight) for p in own}
        means = [-sum(math.log(c[p]) for p in own) / len(own) if own else None for c in (t, b)]
        expected.append((doc_id, len(own), *means, means[0] - means[1] if own else None))
    return sorted(expected, key=repr)


def assert_close(found, expected):
    assert len(found) == len(expected)
    for one, other in zip(found, expected, strict=True):
        assert one[:2] == other[:2] and one[2:] == (None,) * 3 if other[2] is None else one == pytest.approx(other, abs=1e-9)


@pytest.mark.parametrize(("hot", "most", "size"), ((1, 0, 20), (1, 100, 20), (cross_entropy.HOT_ROWS, 100, 1 << 22)))
def test_losses_over_word_pairs_follow_the_definition(spark, docs, monkeypatch, hot, most, size):
    monkeypatch.setattr(cross_entropy, "MOST_BROADCAST", most)
    table = [(1, "The cat  sat on the cat"), (2, "the CAT é 漢"), (3, None), (None, " \n"), (4, "a b"), (4, "a b"), (5, "q r " * 3000)]
    marked = spark.createDataFrame([(1, "x"), (1, "x"), (4, "y"), (99, "z"), (None, "n")], "id long, text string")
    held = [(9, "the cat flew"), (9, None), (None, "a b a b")]
    for scored in (None, held):
        other = None if scored is None else docs(*scored)
        found = rows(cross_entropy.score_words(docs(*table), marked, other, hot=hot, chunk_text=size, range_text=2 * size))
        assert_close(found, scores_by_pairs(table, [1, 4], scored or table))
    none = docs((1, "a")).limit(0)
    assert rows(cross_entropy.score_words(none, marked)) == []
    assert rows(cross_entropy.score_words(docs((1, "a")), marked.limit(0)), "difference") == [(0.0,)]


def test_query(spark, small_folder):
    table = [tuple(r) for r in queries.documents(spark, small_folder).select("doc_id", "text").collect()]
    good = [r.doc_id for r in spark.read.parquet(f"{small_folder}/labels.parquet").filter("quality = 1").collect()]
    columns = ("doc_id", "n_tokens", "target_loss", "background_loss", "difference")
    assert_close(rows(queries.op8_cross_entropy(spark, small_folder), *columns), scores_by_pairs(table, good, table))


def test_texts_and_blocks_are_shuffled_once(spark, docs):
    found = cross_entropy.score_words(docs((1, "a b"), (2, "a b"), clashing=False), spark.createDataFrame([(1,)], "id long"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    for key, most in (("chunk", 3), ("range", 1)):
        assert plan.count(f"Exchange hashpartitioning({key}") - plan.count(f"ReusedExchange [{key}") <= most, plan


def test_what_the_query_gathers_grows_with_the_corpus(spark, small_folder):
    def kinds(folder):
        table = queries.documents(spark, folder)
        counts = cross_entropy.count_pairs(table, table.select("doc_id").limit(0))
        return counts.count(), table.count()

    (few, n), (many, m) = kinds(small_folder), kinds(small_folder.replace("sf0.001", "sf0.01"))
    assert many / few > 0.6 * m / n


def test_held_out_documents_of_good_quality_score_lower_by_words(spark, small_folder):
    folder = small_folder.replace("sf0.001", "sf0.01")
    table, labels = queries.documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    marked = labels.filter("quality = 1").select("doc_id")
    found = cross_entropy.score_words(table.filter("doc_id % 2 = 0"), marked, table.filter("doc_id % 2 = 1"))
    scored = found.join(labels, "doc_id").select("quality", "difference").collect()
    good, bad = ([r[1] for r in scored if r[0] == q and r[1] is not None] for q in (1, 0))
    ordered = sum(a < b for a in good for b in bad) / (len(good) * len(bad))
    assert ordered > 0.85
