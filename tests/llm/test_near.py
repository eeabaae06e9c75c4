"""The near-duplicate stage against brute force over all pairs of fingerprints."""

import numpy as np
from xxhash import xxh64_intdigest

import corpus_pipeline
from costlens.llm import simhash
from costlens.llm.tables import stage
from tests.llm.fixtures import broadcast_limit, no_documents, odd_documents

STAGE = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]


def fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_kept(texts):
    """Smallest number of each group of texts linked by at most three bits."""
    prints, top = [fingerprint(t) for t in texts], list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i for i in range(len(texts)) if find(i) == i}


def copies():
    """Texts with copies of 0 to 12 changed words in 80 to 600, and chains of copies."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for n in (80, 150, 300, 600):
        for _ in range(6):
            base = list(rng.choice(words, n))
            out.append(" ".join(base))
            for changed in (0, 1, 2, 4, 12):
                copy = list(base)
                for at in rng.integers(0, n, changed):
                    copy[at] = str(rng.choice(words))
                out.append(" ".join(copy))
    chain = list(rng.choice(words, 900))
    for i in range(12):
        chain[i * 16] = f"new{i}"
        out.append(" ".join(chain).upper())
    return [out[i] for i in rng.permutation(len(out))]


def test_stage_equals_brute_force(spark):
    texts = copies()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got, want = STAGE(spark, docs, ""), brute_kept(texts)
    assert got.columns == docs.columns and len(want) < len(texts) - 30
    assert {r.doc_id for r in got.collect()} == want


def test_odd_rows(spark):
    docs = odd_documents(spark)
    kept, rows = STAGE(spark, docs, ""), docs.collect()
    assert kept.columns == docs.columns
    assert kept.count() == len(brute_kept([r.text for r in rows]))
    assert STAGE(spark, no_documents(spark), "").count() == 0


def test_balls_are_not_broadcast(spark):
    rng, signed = np.random.default_rng(5), np.int64
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    bits = np.stack([rng.choice(64, 3, replace=False) for _ in base]).astype(np.uint64)
    other = base ^ np.bitwise_or.reduce(np.uint64(1) << bits, axis=1)
    pairs = [(int(a), int(b)) for a, b in zip(base.view(signed), other.view(signed))]
    prints = stage(spark.createDataFrame([(x,) for p in pairs for x in p], "fp long"), "prints")
    with broadcast_limit(spark, "512k", "32m"):
        got = {r.fp: r.component for r in simhash.linked(prints).collect()}
    assert got == {x: min(p) for p in pairs for x in p}
