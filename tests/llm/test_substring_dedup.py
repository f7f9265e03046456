from __future__ import annotations

import hashlib
import random
import re

import pytest

from bazaarium.llm import queries, substring_dedup

from .conftest import rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(table, n):
    """(doc_id, n_words, n_removed, intervals, kept text), straight from the definition."""
    least = {}
    for doc_id, text in table:
        words = words_of(text)
        for i in range(len(words) - n + 1):
            least.setdefault(tuple(words[i : i + n]), set()).add(doc_id)
    first = {w: min(i for i in ids if i is not None) if ids != {None} else None for w, ids in least.items()}
    found = []
    for doc_id, text in table:
        words = words_of(text)
        gone = set()
        for i in range(len(words) - n + 1):
            smallest = first[tuple(words[i : i + n])]
            if smallest is not None and (doc_id is None or smallest < doc_id):
                gone.update(range(i, i + n))
        edges = [i for i in range(len(words)) if i in gone and i - 1 not in gone], [i + 1 for i in range(len(words)) if i in gone and i + 1 not in gone]
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        found.append((doc_id, len(words), len(gone), list(zip(*edges, strict=True)), kept))
    return sorted(found, key=repr)


def as_tuples(found):
    columns = ("doc_id", "n_words", "n_removed", "removed", "kept_text")
    return sorted(((*r[:3], [tuple(x) for x in r[3]], r[4]) for r in rows(found, *columns)), key=repr)


@pytest.mark.parametrize("sizes", ((4 << 20, 8 << 20), (300, 200)))
def test_equals_brute_force_in_any_chunks(spark, docs, sizes):
    rng = random.Random(7)
    passage = [rng.choice("abc") for _ in range(30)]
    table = []
    for i in range(80):
        own = [rng.choice("abcdefgh") for _ in range(rng.randrange(30))]
        cut = rng.randrange(25)
        table.append((rng.randrange(-40, 40), " ".join(own[:10] + passage[cut : cut + rng.randrange(12)] + own[10:])))
    table += [(i, "one text that a third of all rows hold word by word") for i in range(40)]
    found = substring_dedup.remove_repeats(docs(*table), 4, chunk_text=sizes[0], range_text=sizes[1])
    assert as_tuples(found) == expected(table, 4)


def test_edges(spark, docs):
    table = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "a b c d"), (None, "a b c d"), (4, "a  b\tc\nd"), (4, "a b c d"),
        (5, "a b c"), (6, "x a b c d"), (7, "é\xa0è 漢 b c d"), (8, "é\xa0è 漢 b c d e"), (-9, "q " * 9), (9, "q " * 40_000), (10, "w" * 300_000),
    ]
    assert as_tuples(substring_dedup.remove_repeats(docs(*table), 4)) == expected(table, 4)
    assert rows(substring_dedup.remove_repeats(docs((1, "a")).limit(0))) == []


def test_the_text_is_shuffled_once(spark, docs):
    found = substring_dedup.remove_repeats(docs((1, "a b"), (2, "a b"), clashing=False), 2)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(chunk") - plan.count("ReusedExchange") <= 2, plan


def test_query(spark, small_folder):
    table = [tuple(r) for r in queries.documents(spark, small_folder).select("doc_id", "text").collect()]
    want = sorted((*r[:3], hashlib.sha256(r[4].encode()).hexdigest()) for r in expected(table, 13))
    assert rows(queries.op12_substring_dedup(spark, small_folder), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
