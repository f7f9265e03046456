from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from itertools import product

import pytest
import sentencepiece
from tokenizers import Tokenizer

from bazaarium.llm import queries, token_alignment

from .conftest import rows

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tokenizers():
    pytest.importorskip("public_tokenizers")
    return queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")


class Libraries:
    """Groups from the offsets where tokens of both libraries end."""

    def __init__(self, a_path, b_path):
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in plain]
        self.bytes_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}

    def groups(self, text):
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        spelled_a = [bytes(self.bytes_of[c] for c in self.a.id_to_token(i)) for i in a]
        spelled_b = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b
        ]
        if not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
            return []
        found, at_a, at_b, i, j, own_a, own_b = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                own_a.append(a[i])
                at_a, i = at_a + len(spelled_a[i]), i + 1
            else:
                own_b.append(b[j])
                at_b, j = at_b + len(spelled_b[j]), j + 1
            if at_a == at_b:
                found.append((own_a, own_b))
                own_a, own_b = [], []
        return found

    def expected(self, table):
        all_groups = [(doc_id, self.groups(text)) for doc_id, text in table]
        held = [Counter(p for a, b in groups for p in product(a, b)) for _, groups in all_groups]
        count = Counter(p for own in held for p in own)
        highest = defaultdict(int)
        for (a, _), n in count.items():
            highest[a] = max(highest[a], n)
        found = []
        for (doc_id, groups), own in zip(all_groups, held, strict=True):
            shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
            found.append((
                doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()),
                sum(n for p, n in own.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in own.items()),
                hashlib.sha256(shown.encode()).hexdigest() if shown else "",
            ))
        return sorted(found, key=repr)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "a"), (5, "a"), (None, "line one\nline two\r\n\tthree \n four"), (6, "<|endoftext|> </s> <0x41> x"),
    (7, "mark ▁ inside"), (8, "naïve café 漢字 é 👩‍👩‍👧 \xa0 x\xa0y"), (9, "don't we'll I'M 3.14159 --- ==== !!!"), (10, "nul \x00 \x1c   　 end"),
    (11, "a" * 20_000), (12, "漢" * 3_000), (13, "word " * 20_000 + "end"), (14, "﻿bom"), (15, "ﬁ ① ½ Ａ"), (16, "tab\there"), (17, "x \u0085 y"), (18, " q w"),
]


def test_equals_the_libraries(spark, docs, tokenizers):
    libraries = Libraries(*tokenizers)
    found = token_alignment.link_counts(docs(*ODD), *tokenizers)
    assert rows(found, *COLUMNS) == libraries.expected(ODD)
    shown = {r.doc_id: r.groups for r in token_alignment.align(docs(*ODD), *tokenizers).collect()}
    for doc_id, text in ODD:
        want = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in libraries.groups(text))
        assert shown[doc_id] == want


def test_large_groups_add_up_by_distinct_ids(spark, docs, tokenizers, monkeypatch):
    by = token_alignment.Aligner(*tokenizers)
    import pyarrow as pa

    texts = pa.array([t for _, t in ODD if t])
    plain = by.align(texts).pairs()
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", 0)
    monkeypatch.setattr(token_alignment, "STEP", 3)
    stepped = by.align(texts).pairs()
    assert all((a == b).all() for a, b in zip(plain, stepped, strict=True))


def test_words_and_whole_texts_encode_alike(spark, small_folder, tokenizers):
    texts = queries.documents(spark, small_folder).select("text").toArrow().column(0).combine_chunks().drop_null()
    by = token_alignment.Aligner(*tokenizers)
    assert by.by_word
    by_word = by.encode(texts)
    by.by_word = False
    for one, other in zip(by_word, by.encode(texts), strict=True):
        assert all((x == y).all() for x, y in zip(one, other, strict=True))


def test_new_words_are_encoded_together_and_known_ones_not_again(tokenizers, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_alignment, "REMEMBERED", 1500)
    by, libraries, handed = token_alignment.Aligner(*tokenizers), Libraries(*tokenizers), []
    plain = by.sides[0].encode
    monkeypatch.setattr(by.sides[0], "encode", lambda texts: handed.extend(texts) or plain(texts))
    words = [f"wörd{i}\n{i % 7}th's" for i in range(1000)]
    edges = ["a\x0b \x0bb\x0b c", "q \x1fq", "x" * 100 + " \x00y z\x00 w"]
    for batch in (words, words, [w + "!" for w in words], words, edges):
        texts = [" ".join(batch[i : i + 100]) for i in range(0, len(batch), 100)] if batch is not edges else edges
        for number, (ids, sizes) in enumerate(by.encode(pa.array(texts))):
            whole = [libraries.a.encode(" " + t, add_special_tokens=False).ids if number == 0 else libraries.b.encode(t) for t in texts]
            assert ids.tolist() == [i for text in whole for i in text]
            assert sizes.tolist() == [len(text) for text in whole]
        assert len(by.known) <= 2500
    # three batches have new words (the last after all were forgotten), and the edges few
    assert len(handed) < 20


def test_empty_table(spark, docs, tokenizers):
    none = docs((1, "a")).limit(0)
    assert rows(token_alignment.link_counts(none, *tokenizers)) == []
    assert rows(token_alignment.align(none, *tokenizers)) == []


def test_query(spark, small_folder, tokenizers):
    table = [tuple(r) for r in queries.documents(spark, small_folder).select("doc_id", "text").collect()]
    assert rows(queries.op13_token_alignment(spark, small_folder), *COLUMNS) == Libraries(*tokenizers).expected(table)
