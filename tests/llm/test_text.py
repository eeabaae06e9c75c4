"""Rules, lines, personal data, toxicity and mixing on small texts."""

import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from costlens.llm import blockmax, lines, mixing, pii, quality, toxicity
from costlens.llm.tables import stage
from tests.llm.fixtures import ODD_TEXTS, broadcast_limit, no_documents, odd_documents


def brute_repeats(words):
    seen, out = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            out.update(i + k for i in at for k in range(5))
    return len(out)


def test_counts(spark):
    extra = [" ".join("abcde"[(i * i) % 3] for i in range(200)), "a b c d e x a b c d e a b c d e",
             "• x\n- y\n...\nwait...\n#*$%"]
    docs = odd_documents(spark).select("doc_id", "text").union(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    for r in quality.judge(docs).collect():
        t, q = r.text or "", r._q
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)),
            brute_repeats(w))
        assert q.n_twins == sum(a == b for a, b in zip(w, w[1:])) and q.n_lines == len(full)


def test_keep_is_judge(spark):
    good = "The river is long and it was on the map of the land that we had seen before the rain"
    docs = odd_documents(spark).select("doc_id", "text").union(
        spark.createDataFrame([(50, good), (51, good.upper().replace(" ", "!! "))], "doc_id long, text string"))
    kept = {r.doc_id for r in quality.keep(docs).collect()}
    judged = {r.doc_id for r in quality.judge(docs).where("_kept").collect()}
    assert kept == judged and 50 in kept and 51 not in kept
    assert quality.keep(no_documents(spark)).count() == 0


def test_rules_are_one_projection_without_python(spark):
    plan = quality.keep(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_lines(spark):
    far = [(i, f"own words of {i}\nseen on every site\nsecond own {i}", "en", f"s{i}") for i in range(12)]
    near = [(100 + i, "seen on nine sites only\nother", "en", f"s{i % 9}") for i in range(30)]
    df = spark.createDataFrame(far + near + [(200, None, None, None), (201, "", "en", None)],
                               "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in lines.dedup_lines(df, 10).collect()}
    assert got[0].text == far[0][1] and got[0]._n_removed == 0
    assert got[5].text == "own words of 5\nsecond own 5" and got[5]._n_removed == 1
    assert all(got[100 + i].text == near[i][1] for i in range(30))
    assert got[200].text is None and got[201].text == ""
    strict = {r.doc_id: r.text for r in lines.dedup_lines(df, 9).collect()}
    assert strict[100] == near[0][1] and strict[101] == "other"


def test_lines_bear_odd_rows(spark):
    docs = odd_documents(spark)
    got = lines.dedup_lines(docs, 1)
    assert got.columns[:len(docs.columns)] == docs.columns and got.count() == docs.count()
    rows = {r.doc_id: r for r in got.where("doc_id = 12").collect()}
    assert rows[12].text == "line one is here\nline two is here" and rows[12]._n_removed == 1
    assert lines.dedup_lines(no_documents(spark)).count() == 0


def test_lines_of_a_corpus(spark):
    """Passages on two documents of one or nine sites, lines on three, two words on ten."""
    import corpus_pipeline
    passage = {k: " ".join(f"{k}{i}" for i in range(51)) for k in ("one", "two", "nine", "hot")}
    fifty, three, pair = " ".join(f"x{i}" for i in range(50)), "line on three", "two words"
    rows = [(0, f"a\n{passage['two']}", "s0"), (1, f"b\n{passage['two']}\nc", "s1"),
            (2, f"{passage['one']}\n{fifty}", "s0"), (3, f"{fifty}\nd", "s1")]
    rows += [(10 + i, f"own {i}\n{passage['nine']}", f"s{i}") for i in range(9)]
    rows += [(20 + i, f"own {i}\n{passage['hot']}", "s0") for i in range(40)]
    rows += [(70 + i, f"{three}\nown {i}", f"s{i}") for i in range(3)]
    rows += [(80 + i, f"{pair}\nnine sites {i % 9}" if i < 9 else pair, f"s{i}") for i in range(10)]
    rows += [(100, None, None), (101, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    want = {i: t for i, t, _ in rows}
    want[1] = "b\nc"
    want |= {10 + i: f"own {i}" for i in range(1, 9)} | {20 + i: f"own {i}" for i in range(1, 40)}
    want |= {70 + i: f"own {i}" for i in (1, 2)} | {80 + i: f"nine sites {i}" for i in range(1, 9)}
    assert got == want | {89: ""}


def test_lines_are_not_broadcast(spark):
    """A small file of repeated texts holds many lines once they are unpacked."""
    texts = ["\n".join(f"the {1000 * k + i} line" for i in range(1000)) for k in range(20)]
    rows = [(i, texts[i % 20], f"s{i}") for i in range(600)]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1),
                 "packed")
    with broadcast_limit(spark, "256k", "32m"):
        got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == {i: t if i < 20 else "" for i, t, _ in rows}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        s += n - 9 * (n > 9)
    return s % 10 == 0


def brute_spans(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 1,
                  "card": 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 1,
                  "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def hard_texts():
    rng = np.random.default_rng(3)
    parts = ["a@b.c", "x.y@z", "+1 ", "1.2.3.4", "300.1.1.1", "0001.2.3.004", "4111111111111111", " - ", "..",
             "é😀", "@", "+44 20 7946 0958", "4111-1111 1111-1111", "\n", "q+w@e-r.t.y", "12 3", "1234.5", "+"]
    return ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(400)] + [
        "1" * 30_000, "a" * 30_000, "1." * 20_000, "a@b" + ".c" * 20_000, "+1" + " (" * 20_000,
        "a@b.c " * 3000, "9 " * 20_000]


def test_base_spans(spark):
    texts = ODD_TEXTS + hard_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    base = F.concat(*[pii.written(k, F.col(f"_base.{k}")) for k in pii.KINDS])
    got = pii.extract(df).select("doc_id", F.array_join(base, ",").alias("s"),
                                 F.sha2(F.array_join(base, ","), 256).alias("h")).collect()
    for r in got:
        want = brute_spans(texts[r.doc_id] or "")
        assert r.s == want, texts[r.doc_id][:200]
        assert r.h == hashlib.sha256(want.encode()).hexdigest()


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"some words then password={i:08x}{i * 7919:012x} and more") for i in range(12)]
    rows += [(50, "here password=hunter22x is set"), (51, "version 2.0.1-beta of it"),
             (52, "the year 2024 and room 12b45c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s.value for s in r._more or []] for r in pii.extract(df).collect()}
    assert got[50] == ["hunter22x"] and not got[51] and not got[52] and len(got[3]) == 1


def test_pii_bears_odd_rows(spark):
    docs = odd_documents(spark)
    assert pii.extract(docs).count() == docs.count()
    assert pii.extract(no_documents(spark)).count() == 0
    plan = pii.extract(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def corpus(spark, n=400):
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, 40))
        if i % 4 == 0:
            w[5] = w[20] = ["vile", "scum", "filth"][i % 3]
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_on_unseen_documents(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels.where("doc_id % 5 <> 0"), "toxic", examples=200)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if i % 5 == 0]
    right = sum(got[i].predicted == int(i % 4 == 0) for i in held)
    assert right / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert len(got[40].evidence) == 5
    odd = toxicity.score(odd_documents(spark), model)
    assert odd.count() == odd_documents(spark).count()
    none = toxicity.fit(no_documents(spark), labels.limit(0), "toxic")
    assert toxicity.score(docs, none).agg(F.max("score")).first()[0] == 0


def test_toxicity_looks_at_all_terms(spark):
    """A word that one example holds finds that example; cosines are those of whole texts."""
    docs, labels = corpus(spark)
    rare = spark.createDataFrame([(900, "quibbish zorvath wab wcd", "en", "s"),
                                  (901, "a quibbish zorvath unseenword of it", "en", "s")], docs.schema)
    docs = docs.union(rare)
    told = labels.union(spark.createDataFrame([(900, 0, 1)], labels.schema))
    model = toxicity.fit(docs, told, "toxic", examples=1000)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[901].evidence[0] == "900" and all(len(r.evidence) == 5 for i, r in got.items() if i < 400)
    texts = {r.doc_id: r.text for r in docs.collect()}
    idf = blockmax.load(model.path)["idf"]
    present = Counter(t for text in texts.values() for t in set(text.split()))
    plain = np.log((1 + len(texts)) / (1 + np.array([present[w] for w in ("wab", "quibbish", "vile")]))) + 1
    assert np.allclose(idf[[blockmax.feature(w) for w in ("wab", "quibbish", "vile")]],
                       plain * [1, 1, toxicity.EXTRA], rtol=1e-6)

    def vector(text):
        v = {t: (1 + np.log(c)) * float(idf[blockmax.feature(t)]) for t, c in Counter(text.split()).items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}
    examples = [(i, vector(texts[i])) for i in [*range(400), 900]]
    for i in (901, 3, 8):
        q = vector(texts[i])
        want = sorted((sum(x * v.get(t, 0) for t, x in q.items()) for _, v in examples), reverse=True)
        assert np.allclose(got[i].cosines, [c for c in want[:5] if c > 0])


def test_votes_leave_the_example_out(spark):
    docs, labels = corpus(spark, 80)
    model = toxicity.fit(docs, labels, "toxic", k=5)
    held, index = blockmax.opened(model.path)
    got = toxicity.votes_of_others(spark, model.path, 80, 5).to_pylist()
    dense = np.zeros((80, blockmax.SIZE), np.float32)
    dense[np.repeat(np.arange(80), np.diff(held["edges"])), held["term"]] = held["weight"]
    cosine = (dense @ dense.T).astype(float)
    np.fill_diagonal(cosine, -1)
    for r in got:
        near = np.argsort(-cosine[r["place"]], kind="stable")[:5]
        assert np.isclose(r["vote"], toxicity.vote(cosine[r["place"], near], held["label"][near]), atol=1e-4)
        assert r["y"] == held["label"][r["place"]]


@pytest.mark.parametrize("rows, share, long", [(300, 0.15, 0.1), (1500, 0.02, 1 / 64), (700, 0.3, 2.0),
                                               (3, 0.5, 1 / 16)])
def test_block_max_is_exact(monkeypatch, rows, share, long):
    """Short lists alone, long ones alone and both give the brute-force neighbours, with ties."""
    monkeypatch.setattr(blockmax, "LONG", long)
    rng = np.random.default_rng(2)
    dense = rng.random((rows, 60)) * (rng.random((rows, 60)) < share * np.linspace(0.1, 2, 60))
    dense[rows // 2:rows // 2 + 9] = dense[:9][:max(0, min(9, rows - rows // 2))]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    row, term = np.nonzero(dense)
    index = blockmax.Index(row, term * 7, dense[row, term], rows)
    asked = np.arange(0, rows, 2)
    q, t = np.nonzero(dense[asked])
    got = index.nearest(q, t * 7, dense[asked][q, t], len(asked), 10, asked)
    for i, (found, score) in zip(asked, got):
        s = np.round(dense @ dense[i], 12)
        want = sorted((-s[j], j) for j in range(rows) if j != i and s[j] > 0)[:10]
        assert [int(f) for f in found] == [j for _, j in want]


def test_block_max_skips_blocks():
    """Blocks whose peaks cannot reach a query's k-th cosine are not multiplied."""
    rng = np.random.default_rng(5)
    dense = np.zeros((2048, 40))
    for b in range(8):
        dense[b * 256:(b + 1) * 256, b * 5:b * 5 + 5] = rng.random((256, 5))
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    row, term = np.nonzero(dense)
    index = blockmax.Index(row, term, dense[row, term], 2048)
    q, t = np.nonzero(dense)
    index.nearest(q, t, dense[q, t], 2048, 10)
    assert len(index.matrix) == 40 and index.products == 2048


def test_features_look_at_odd_pieces_only(monkeypatch):
    """Features are hashed lower-cased runs of letters; ASCII is cut in its bytes, and only
    distinct pieces with other characters are looked at by pattern."""
    seen, replace = [], blockmax.pc.replace_substring_regex
    monkeypatch.setattr(blockmax.pc, "replace_substring_regex",
                        lambda values, *a: seen.extend(values.to_pylist()) or replace(values, *a))
    texts = [None, "", "Plain words, PLAIN text_2x", "ends", "joined?", " ", "\x00a\x7fb",
             "Été—été…ÉTÉ Été—été", "日本語。テスト、、ok x", "٣٤ a٣b été", "— …", "no end"] * 3
    row, term, count = blockmax.features(pa.array(texts).slice(1))
    want = Counter()
    for i, text in enumerate(texts[1:]):
        plain = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
        want.update((i, blockmax.feature(t)) for t in plain.split())
    assert dict(zip(zip(row.tolist(), term.tolist()), count.tolist())) == want
    assert list(zip(row, term)) == sorted(zip(row, term))
    assert sorted(seen) == sorted({"été—été…été", "日本語。テスト、、ok", "٣٤", "a٣b", "été", "—", "…",
                                   "été—été"})
    assert [len(x) for x in blockmax.features(pa.array([], pa.string()))] == [0, 0, 0]


def test_short_lists_are_read_in_small_parts(monkeypatch):
    """Postings that are added up together fit a core's cache; results stay exact."""
    rng = np.random.default_rng(7)
    dense = rng.random((4096, 400)) * (rng.random((4096, 400)) < 0.05)
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    row, term = np.nonzero(dense)
    index = blockmax.Index(row, term, dense[row, term], 4096)
    parts, ragged = [], blockmax.ragged
    monkeypatch.setattr(blockmax, "ragged",
                        lambda start, length: parts.append(length.sum()) or ragged(start, length))
    q, t = np.nonzero(dense[:300])
    got = index.nearest(q, t, dense[:300][q, t], 300, 10)
    assert not len(index.matrix) and sum(parts) > 1_000_000 and max(parts) <= 1 << 16
    for i, (found, _) in enumerate(got):
        s = np.round(dense @ dense[i], 12)
        assert found.tolist() == sorted(np.flatnonzero(s > 0), key=lambda j: (-s[j], j))[:10]


def test_mixture_meets_targets(spark):
    docs, labels = corpus(spark)
    named = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("good").alias("domain"))
    model = mixing.fit(docs, named, per_class=200)
    got = mixing.mix(docs, model, {"good": 0.9, "toxic": 0.1}).collect()
    p = np.array([r.p for r in got])
    n, rate = np.array([r.n_tokens for r in got]), np.array([r.rate for r in got])
    held = (n * rate) @ p
    assert (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    assert np.abs(held - n.sum() * np.array([0.9, 0.1])).max() < 0.002 * n.sum()
    left = mixing.resample(docs, model, {"good": 1.0, "toxic": 0.0}, "domain")
    ids = {r.doc_id for r in left.collect()}
    assert left.columns == docs.columns and len({i for i in ids if i % 4 == 0}) < 10 and len(ids) > 280


def test_small_domains_meet_their_targets(spark, caplog):
    """A domain of 0.05 % of the tokens moves to a tenth; unreachable targets are reported."""
    rows = [(i, 100, [0.0005 / 3, 0.0, 1 - 0.0005 / 3] if i % 2000 else [0.0, 0.98, 0.02])
            for i in range(20_000)]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>")
    held = mixing.totals(members, 3, [])[0]
    targets = held * np.array([1.0, 0.1, 1.0])
    history, unmet = mixing.solve(members, targets)
    done = mixing.totals(members, 3, history)[0]
    assert abs(done[1] - targets[1]) <= 100 < 0.001 * targets.sum() and not unmet.any()
    assert len(history) < 10
    docs, labels = corpus(spark, 80)
    one = mixing.fit(docs, labels.select("doc_id", F.lit("one").alias("domain")))
    mixing.plan(docs, one, {"one": 1.0}, "total", 60)
    assert "unmet" not in caplog.text
    mixing.plan(docs, one, {"one": 3.0}, "total", 0)
    assert "unmet" in caplog.text


def test_resample_meets_fractional_targets(spark):
    docs, labels = corpus(spark, 2000)
    named = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("good").alias("domain"))
    model = mixing.fit(docs, named, per_class=200)
    for shares in ({"good": 1.0, "toxic": 0.1}, {"good": 1.3, "toxic": 0.4}):
        ids = [r.doc_id for r in mixing.resample(docs, model, shares, "domain").select("doc_id").collect()]
        held = {"good": sum(i % 4 > 0 for i in ids) / 1500, "toxic": sum(i % 4 == 0 for i in ids) / 500}
        assert all(abs(held[d] - shares[d]) < 0.06 for d in shares), held
    same = docs.limit(1).crossJoin(spark.range(1000)).select(*docs.columns)
    one = mixing.fit(docs, labels.select("doc_id", F.lit("one").alias("domain")))
    assert 200 < mixing.resample(same, one, {"one": 0.25}).count() < 300


def test_mixture_bears_odd_rows(spark):
    docs, labels = corpus(spark, 80)
    model = mixing.fit(docs, labels.select("doc_id", F.lit("one").alias("domain")))
    odd = odd_documents(spark)
    assert mixing.mix(odd, model, {"one": 1.0}).count() == odd.count()
    assert mixing.resample(odd, model, {"one": 2.0}).count() == 2 * odd.count()
    assert mixing.mix(no_documents(spark), model, {"one": 1.0}).count() == 0


@pytest.mark.parametrize("n", [0, 1, 128, 129, 1000])
def test_running_sums(spark, n):
    df = spark.createDataFrame([([int(i % 7) for i in range(n)],)], "a array<bigint>")
    assert df.select(pii.running(F.col("a"))).first()[0] == np.cumsum([i % 7 for i in range(n)]).tolist()
