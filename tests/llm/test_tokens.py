"""Encoding, packed files and sequences: exact round trips."""

import zlib
from io import BytesIO

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from costlens.llm import packing, queries, tokens
from costlens.llm.bits import Reader, Writer, pack, unpack, width
from costlens.llm.encode import Encoder
from tests.llm.fixtures import no_documents, odd_documents

FILES = [queries.BYTE_BPE, queries.WORD_BPE]


@pytest.fixture(scope="module")
def encoders():
    return [Encoder(queries.vocabulary_file(f)) for f in FILES]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(
    alphabet="aB é.,!'\n\t 1\u00a0\u2009\x1c\x85-_", max_size=40)), max_size=5))
def test_ids_are_those_of_the_whole_text(encoders, texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    for e in encoders:
        ids, at = e.encode(pa.array(texts, pa.string()))
        want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts],
                                                         add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert unpack(data, 1001, bits).tolist() == ids.tolist()


def test_width():
    assert [width(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_file_gives_any_range():
    class Source(BytesIO):
        def size(self):
            return len(self.getvalue())

    ids = np.random.default_rng(0).integers(0, 49408, 100_000).astype("<u4")
    ends = np.array([0, 5, 70_000, 100_000])
    sink = BytesIO()
    w = Writer(sink, 16)
    w.add(pa.array([1, 2]), ids[:5], ends[:2])
    w.add(pa.array([3, None]), ids[5:], ends[2:] - 5)
    w.close()
    r = Reader(Source(sink.getvalue()))
    assert r.ids(32_000, 66_000).tolist() == ids[32_000:66_000].tolist()
    assert [k for keys, _, _ in r.documents(3) for k in keys.to_pylist()] == [1, 2, 3, None]
    assert r.ends.tolist() == ends.tolist()


def test_token_files(spark):
    path = queries.vocabulary_file(queries.WORD_BPE)
    docs = odd_documents(spark)
    got = tokens.token_files(docs, path, queries.WORD_IDS).orderBy("start").collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    key = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert key == sorted(key)
    e, start = Encoder(path), 0
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for r in got:
        assert r.start == start
        start += r.n_tokens
        want = [e.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts[r.doc_id]]
        assert np.frombuffer(r.ids, "<u4").tolist() in want and len(r.ids) == 4 * r.n_tokens


def test_pack(spark):
    path = queries.vocabulary_file(queries.BYTE_BPE)
    docs = odd_documents(spark)
    got = packing.pack(docs, path, queries.BYTE_IDS, 64).collect()
    seqs = {}
    for r in got:
        assert r.length == len(r.ids) // 4 > 0 and r.offset + r.length <= 64
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(r.length for r in got)
    assert sorted(seqs) == list(range(-(-total // 64)))
    for s, pieces in seqs.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 64 or s == max(seqs)
    e = Encoder(path)
    want = sorted(tuple(e.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])
                  for r in docs.collect())
    glued, ordered = [], sorted(got, key=lambda r: (r.sequence_id, r.offset))
    for r in ordered:
        if r.start == 0:
            glued.append(())
        glued[-1] += tuple(np.frombuffer(r.ids, "<u4").tolist())
    assert sorted(glued) == want


def test_hilbert_visits_every_cell_by_unit_steps():
    n = 8
    cells = np.stack(np.meshgrid(*[np.arange(n)] * 2, indexing="ij"), -1).reshape(-1, 2)
    order = np.argsort(packing.hilbert(cells, 3))
    assert sorted(packing.hilbert(cells, 3)) == list(range(n * n))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_no_rows(spark):
    for f, n, run in ((FILES[0], queries.BYTE_IDS, packing.pack),
                      (FILES[1], queries.WORD_IDS, tokens.token_files)):
        assert run(no_documents(spark), queries.vocabulary_file(f), n).count() == 0


def test_crc(spark):
    assert tokens.crc32(np.array([1, 2], np.uint32)) == zlib.crc32(b"\1\0\0\0\2\0\0\0")


def test_frequent_pieces_survive_a_full_table(encoders, monkeypatch):
    from costlens.llm import encode
    monkeypatch.setattr(encode, "CACHE_PIECES", 4)
    for path in FILES:
        e = Encoder(queries.vocabulary_file(path))
        for texts in (["One two, three four five", "two, TWO six"], ["seven two, one"], ["one"]):
            ids, at = e.encode(pa.array(texts))
            want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_flat_binaries_round_trip():
    data = np.arange(10, dtype="<u2")
    values = packing.binaries(data, np.array([0, 3, 3, 10]))
    assert [len(v.as_py()) for v in values] == [6, 0, 14]
    assert packing.flat(values[1:], "<u2").tolist() == list(range(3, 10))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aZsté '\n\t\r\x00\x1c.,$#<|>~1\u0301\u0338ßΣ", max_size=30),
                max_size=5))
def test_cuts_behind_any_ascii_mark_keep_the_ids(encoders, texts):
    texts += ["a<|endoftext|>b.\n<|endoftext|>", "x's\nS 's\nT a$\n\nB", "ab.\nCd.\nEf"]
    for e in encoders:
        ids, at = e.encode(pa.array(texts, pa.string()))
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_the_library_meets_marks_once_whatever_word_they_follow(monkeypatch):
    e = Encoder(queries.vocabulary_file(queries.BYTE_BPE))
    met, plain = [], e._ids
    monkeypatch.setattr(e, "_ids", lambda texts: met.extend(texts) or plain(texts))
    text = "so uno$$$ dos$$$ tres, fin.\nUna año.\nOtra, mil.\nAl"
    ids, _ = e.encode(pa.array([text]))
    assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(met) == sorted(["$$$", ",", ".\n", ","])


def test_cells_are_those_of_the_mean_signs():
    rng = np.random.default_rng(3)
    for dims in (3, 4):
        ids, bounds = rng.integers(0, 50257, 500).astype(np.uint32), np.array([0, 0, 7, 8, 8, 500])
        signs = packing.projection(1 << 16, dims)
        mean = np.array([signs[ids[a:b]].mean(axis=0, dtype=np.float64) if b > a else np.zeros(dims)
                         for a, b in zip(bounds[:-1], bounds[1:])])
        want = ((np.sign(mean) * np.sqrt(np.abs(mean)) + 1) / 2 * 256).astype(int).clip(max=255)
        assert packing.grid(ids, bounds, signs).tolist() == want.tolist()


def test_a_word_has_one_row_whatever_marks_follow_it():
    e = Encoder(queries.vocabulary_file(queries.BYTE_BPE))
    text = "so uno, uno. uno; uno! uno\nuno.\nuno uno"
    ids, _ = e.encode(pa.array([text]))
    assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    words, marks = ["so", " uno", "uno"], [",", ".", ";", "!", "\n", ".\n"]
    assert len(e.start) == len(words + marks)


def test_cuts_never_cross_texts(encoders):
    texts = ["x", "ab", "cd", "", "ef\n", "gh", None, "\nij", "kl ", "mn", " ", "op", "Ã", "©",
             "q\u00d7", "r\u00f7s", "\u00e9", "t\n\nu", "\u00ab\nv", "w\t x", "<|endoftext|>\ny", "\u00e9\nz"]
    for cut in (0, 1):
        rows = pa.array(texts)[cut:]
        for e in encoders:
            ids, at = e.encode(rows)
            want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in rows.to_pylist()],
                                                            add_special_tokens=False)]
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
            for t, w in zip(rows.to_pylist(), want):
                assert e.encode(pa.array([t], pa.string()))[0].tolist() == w


def test_pieces_without_latin_letters_are_met_once(monkeypatch):
    for path in FILES:
        e = Encoder(queries.vocabulary_file(path))
        texts = pa.array(["слово, 1999 δ\nuno, 日本 слово,"])
        first, met, plain = e.encode(texts)[0].tolist(), [], e._ids
        rows = len(e.start)
        monkeypatch.setattr(e, "_ids", lambda texts: met.extend(texts) or plain(texts))
        assert e.encode(texts)[0].tolist() == first and met == [] and len(e.start) == rows
