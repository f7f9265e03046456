from __future__ import annotations

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from bazaarium.llm import piece_transducer, queries

from .conftest import rows

pytest.importorskip("public_tokenizers")
PATH = queries.tokenizer("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MACHINE = piece_transducer.PieceTransducer(PATH)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text(alphabet=" ▁\nabehlotin.é漢\x00", max_size=60)))
def test_the_shortest_path_is_the_librarys_encoding_and_decoding_gives_the_text(text):
    ids = list(MACHINE.encode(text))
    assert ids == LIBRARY.encode(text)
    if piece_transducer.MARK not in text:
        assert MACHINE.decode(ids) == text


def test_runs_of_spaces():
    for n in range(1, 70):
        text = f"a{' ' * n}b"
        assert list(MACHINE.encode(text)) == LIBRARY.encode(text) and MACHINE.decode(MACHINE.encode(text)) == text


def test_a_unigram_model_takes_the_path_of_least_weight():
    machine = piece_transducer.PieceTransducer(PATH)
    machine.by_rank = False
    machine.pieces = {p: i for i, p in enumerate(["▁a", "b", "ab", "▁", "a", "bab"])}
    machine.scores = [-3.0, -2.0, -2.5, -1.0, -2.0, -3.5]
    machine._compile()
    machine.bytes_of = [p.replace("▁", " ").encode() for p in machine.pieces]

    def paths(text):
        if not text:
            yield 0.0, []
        for piece, i in machine.pieces.items():
            if text.startswith(piece):
                for cost, rest in paths(text[len(piece) :]):
                    yield cost - machine.scores[i], [i, *rest]

    for text in ("abab", "ba", "aab", "b abab"):
        ids = list(machine.encode(text))
        best = min(paths("▁" + text.replace(" ", "▁")))
        assert -sum(machine.scores[i] for i in ids) == pytest.approx(best[0])
        assert machine.decode(ids) == text


def test_bytes_that_are_no_text_are_replaced():
    assert MACHINE.decode([MACHINE.byte_ids[0xFF]]) == "�" and MACHINE.decode([]) == ""


def test_models_that_rewrite_characters_are_refused():
    with pytest.raises(ValueError):
        piece_transducer.Normaliser({2: b"map"})


def test_edges(spark, docs):
    table = docs((None, None), (1, ""), (2, "x"), (2, "x"), (3, "word " * 20_000), (4, "a▁b"))
    encoded = piece_transducer.encode(table, PATH)
    back = rows(piece_transducer.decode(encoded, PATH))
    assert back == sorted([(None, ""), (1, ""), (2, "x"), (2, "x"), (3, "word " * 20_000), (4, "a b")], key=repr)
    assert rows(encoded, "doc_id", "round_trip") == sorted([(None, True), (1, True), (2, True), (2, True), (3, True), (4, False)], key=repr)
    assert rows(piece_transducer.encode(table.limit(0), PATH)) == []


def test_the_query_holds_for_every_document(spark, small_folder):
    import zlib
    from array import array

    found = {r["doc_id"]: r for r in queries.op9_piece_transducer(spark, small_folder).collect()}
    for row in queries.documents(spark, small_folder).collect():
        ids = LIBRARY.encode(row["text"] or "")
        held = found.pop(row["doc_id"])
        assert (held["n_pieces"], held["ids_crc32"], held["round_trip"]) == (len(ids), zlib.crc32(array("I", ids).tobytes()), True)
    assert not found
