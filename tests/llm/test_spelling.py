"""Spelling variants beside all pairs and a plain reading of the rules."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from costlens.llm import spelling
from tests.llm.fixtures import no_documents, odd_documents


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(vocabulary):
    """{word: (form, root, n, n_near, form_n)}"""
    masks = {}
    for w in vocabulary:
        for i in range(len(w)):
            for mask in {w[:i] + "." + w[i + 1:], w[:i] + "." + w[i:], w + "."}:
                masks.setdefault(mask, set()).add(w)
    near = {w: set() for w in vocabulary}
    for group in masks.values():
        for w in group:
            near[w] |= {x for x in group if one_edit(w, x)}
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best and vocabulary[best] >= 10 * n else None
    out = {}
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), vocabulary.get(form[w]))
    return out


def counted(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def result(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute(counted(docs.select("doc_id", "text").collect()))
    assert sum(v[0] is not None for v in want.values()) > 5
    assert result(spelling.variants(docs)) == want


@pytest.mark.parametrize("limit", [2, 4096])
def test_lists_that_are_split(spark, limit):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abÿ"), rng.integers(7, 11))) for _ in range(700)}
    words |= {"x" * n for n in range(7, 40)} | {"long" * 60 + c for c in "abc"} | {"prefix" + c for c in "abcà×"}
    vocabulary = {w: int(n) for w, n in zip(sorted(words), rng.integers(2, 900, len(words)))}
    table = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best.word) for r in spelling.near(table, limit).collect()}
    want = {w: v for w, v in brute(vocabulary).items() if v[3]}
    assert {w: g[0] for w, g in got.items()} == {w: v[3] for w, v in want.items()}
    for w, v in want.items():
        assert v[0] in (None, got[w][1])


def test_forms_lead_to_roots(spark):
    n = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "tieword": 3, "tiewora": 30,
         "tieworb": 30}
    rows = [(0, " ".join(" ".join([w] * k) for w, k in n.items()))]
    rows = [(i, rows[0][1]) for i in range(40)
            if not any(zlib.crc32(f"{i}:{w}".encode()) % 31 == 0 for w in n)][:1]
    got = result(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got["aaaaaaa"][:2] == ("aaaaaab", "aaaabbb") and got["aaaabbb"][:2] == (None, "aaaabbb")
    assert got["tieword"][0] == "tiewora" and got["tieword"][3] == 2


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abÿ", min_size=1, max_size=9), min_size=1, max_size=30))
def test_scan_is_all_pairs(words):
    words = sorted(words)
    letters, lengths = spelling.matrix(pa.array(words))
    n = len(words)
    first, last = np.zeros(n, np.int64), np.full(n, n)
    a, b = spelling.scan(letters, lengths, spelling.prefixes(letters, first), first, last,
                         np.zeros(n, np.int64), np.arange(n))
    got = {(words[i], words[j]) for i, j in zip(a, b)}
    assert got == {(x, y) for x in words for y in words if one_edit(x, y)} and len(got) == len(a)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    want = brute(counted([(r.doc_id, r.text) for r in docs.collect()]))
    assert result(spelling.variants(docs)) == want and want


def test_no_rows(spark):
    assert spelling.variants(no_documents(spark)).count() == 0
