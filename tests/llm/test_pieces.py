"""Piece ids and texts beside the library's own."""

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor

from costlens.llm import pieces, queries
from tests.llm.fixtures import no_documents, odd_documents

PATH = queries.vocabulary_file(queries.PIECE_BPE)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(PATH)


def same(encoder, library, texts):
    ids, at = encoder.encode(pa.array(["before", *texts], pa.string())[1:])
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got == library.encode(texts, add_eos=True)
    assert [encoder.model.decode(i) for i in got] == [library.decode(i) for i in got]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("ab ▁\n\té.'-1中🙂", max_size=60)), max_size=6))
def test_ids_and_texts_are_the_librarys(encoder, library, texts):
    same(encoder, library, [t.encode("utf-8", "ignore").decode() for t in texts])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(259, 31999), max_size=12))
def test_joined_pieces(encoder, library, ids):
    same(encoder, library, ["".join(library.id_to_piece(i) for i in ids).replace("▁", " ")])


def test_runs_and_long_words(encoder, library):
    same(encoder, library, [" " * k for k in range(70)] + ["a" * k for k in range(90)]
         + [" " * k + "\n x" + " " * k for k in range(40)]
         + ["é" * 20_000, "the" * 7000, " " * 5000, "ab" * 4000 + "  " * 40 + "c"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(3, 258)), max_size=10))
def test_any_ids_decode_as_in_the_library(encoder, library, ids):
    assert encoder.model.decode(ids) == library.decode(ids)


def test_backtracking_finds_what_merging_makes(encoder):
    model = encoder.model
    for word in ("threlyes", "ofthstthor", "edoution", "andthander", "aaaaaaa", "ththththth"):
        assert [model.id_of[p] for p in model.merge(word)] == model.backtrack(word)


def test_remembered_words_are_bounded(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    e = pieces.Encoder(PATH)
    for texts in (["one two three four"], ["five six one"], ["one", "", "two"]):
        same(e, library, texts)
    assert len(e.row) <= 7


def test_odd_rows(spark, library):
    docs = odd_documents(spark)
    got = pieces.encode(docs, PATH).collect()
    want = [(r.doc_id, library.encode(r.text or "", add_eos=True)) for r in docs.collect()]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(k), i) for k, i in want)
    assert all(r.decoded == library.decode(r.ids) for r in got)


def test_no_rows(spark):
    assert pieces.encode(no_documents(spark), PATH).count() == 0


def test_other_models_are_refused(tmp_path):
    with pytest.raises((ValueError, OSError, RuntimeError)):
        pieces.Model(str(tmp_path / "none.model"))
