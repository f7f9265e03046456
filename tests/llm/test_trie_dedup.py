from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bazaarium.llm import queries, trie_dedup

from .conftest import rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=40))
def test_a_trie_holds_each_key_once_and_in_order(keys):
    trie = trie_dedup.RadixTrie()
    for key in keys:
        trie.insert(key, 1, lambda old, new: old + new)
    assert list(trie.terminals()) == sorted(Counter(keys).items())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=4), max_size=30), st.binary(max_size=4))
def test_subtrees_below_a_bound_leave_and_the_rest_stays(keys, bound):
    trie = trie_dedup.RadixTrie()
    for key in keys:
        trie.insert(key, 1, lambda old, new: old)
    below = [key for key, _ in trie.take_below(bound)]
    rest = [key for key, _ in trie.terminals()]
    assert below == sorted(k for k in set(keys) if k < bound) and rest == sorted(k for k in set(keys) if k >= bound)


def expected(table: list[tuple], largest: bool) -> list[tuple]:
    groups: dict[str, list] = {}
    for doc_id, text in table:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max(known) if largest else min(known)) if known else None
        kept = False
        for doc_id in ids:
            first = doc_id == best and not kept
            kept |= first
            out.append((doc_id, best, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


TABLE = [(1, "a"), (7, "a"), (7, "a"), (7, "b"), (3, None), (4, ""), (None, "a"), (None, "n"), (None, "n"), (9, "x" * 100_000), (8, "x" * 100_000)]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("budget", [trie_dedup.TRIE_BYTES, 1])
def test_owners_of_nulls_ties_and_repeated_rows(docs, keep, budget):
    table = docs(*TABLE).repartition(3)
    assert rows(trie_dedup.assign(table, keep, budget=budget)) == expected(TABLE, keep == "largest")
    stay = trie_dedup.owners(table, keep, budget=budget)
    assert stay.columns == [*table.columns, "group_size"]
    assert rows(stay, "text").__len__() == len({t or "" for _, t in TABLE})


def test_an_empty_table_gives_an_empty_result(docs):
    assert rows(trie_dedup.assign(docs((1, "a")).limit(0))) == []


def test_the_query_holds_for_every_document(spark, small_folder):
    table = [(r["doc_id"], r["text"]) for r in queries.documents(spark, small_folder).collect()]
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(queries.op3_exact_dedup(spark, small_folder), *names) == expected(table, True)
