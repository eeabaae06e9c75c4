"""Exact top-k, SimHash links and url templates against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from costlens.llm import simhash, topk, urls
from costlens.llm.components import components
from tests.llm.fixtures import no_documents, odd_documents


@pytest.mark.parametrize("n,kind", [(3, "ties"), (400, "random"), (400, "ties"), (300, "large")])
def test_block_top_k_is_exact(n, kind):
    rng = np.random.default_rng(n)
    v = rng.integers(-200, 200, (n, 16)) if kind == "random" else rng.integers(-1, 2, (n, 16))
    if kind == "large":
        v = rng.integers(-2 ** 28, 2 ** 28, (n, 16))
    ids = rng.permutation(n) * 3
    row, at, score = topk.top_of_block(ids, v, ids[:20], v[:20], 5)
    for q in range(min(20, n)):
        s = v @ v[q]
        want = sorted((-s[i], ids[i]) for i in range(n) if ids[i] != ids[q])[:5]
        got = [(-s_, ids[a]) for r, a, s_ in zip(row, at, score) if r == q]
        assert got == want


def test_top_k_bears_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [0.5, 0.5]),
            (5, [0.5, 0.5]), (6, [float("inf"), 0.0]), (7, [1.0, 2.0, 3.0]), (8, [-1.0, 0.001]),
            (None, [1.0, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0))
    got = topk.top_k(df, df.where("vec_id in (1, 5, 7, 9)"), k=5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, 5, 256 * 128 + 512 * 128), (1, 2, 8, -256 * 256),
        (5, 1, 1, 256 * 128 + 512 * 128), (5, 2, 8, -256 * 128)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def brute_fp(text):
    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    hs = hs if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(spark):
    for r in simhash.fingerprints(odd_documents(spark)).join(
            odd_documents(spark).select("doc_id", "text"), "doc_id").collect():
        assert r.fp % (1 << 64) == brute_fp(r.text)


def brute_components(fps, distance=3):
    top = {f: f for f in fps}

    def find(f):
        while top[f] != f:
            f = top[f]
        return f
    for a in fps:
        for b in fps:
            if bin((a ^ b) % (1 << 64)).count("1") <= distance:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_links(spark, distance):
    rng = np.random.default_rng(5)
    fps = {0, -1, 1 << 40}
    for _ in range(6):
        base = int(rng.integers(-2 ** 63, 2 ** 63))
        bits = rng.choice(64, 14, replace=False)
        for _ in range(25):
            x = base % (1 << 64)
            for b in rng.choice(bits, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.fp: r.component for r in simhash.linked(df, distance).collect()}
    assert got == brute_components(sorted(fps), distance)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_near_duplicates(spark):
    docs = odd_documents(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    tops = brute_components(sorted({r.fp for r in got}))
    for r in got:
        ids = [x.doc_id for x in got if tops[x.fp] == tops[r.fp] and x.doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(tops.values()))
    assert simhash.keep_one(no_documents(spark)).count() == 0


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(
        ["https://A.example.org/es/x?q#f", "http://example.org/en/12", "http://example.org/en/2/1",
         "ftp://x.com/fr/", "http://com/de/a", "nothing", None, "http://x.com", "://h?x/de/", "a://b://c",
         "http://notorg/", "http://y.com/de"]
        + [f"http://z.com/de/{i}" for i in range(30)] + [f"http://z.com/it/{i}" for i in range(30)]
        + [f"http://z.com/fr/{i}" for i in range(30)])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("n", F.lit(1))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(12)] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "/en/2/1", "org/", "allow"), ("x.com", "/fr/", "com/fr/", "allow"),
        ("com", "/de/a", "com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("x.com", "", None, "allow"), ("h", "", None, "allow"), ("b:", "//c", None, "allow"),
        ("notorg", "/", None, "allow"), ("y.com", "/de", None, "allow")]
    by = {got[i].path.split("/")[1]: got[i] for i in range(12, 102)}
    assert by["de"].template == "/de/*" and by["fr"].template == "/fr/*"
    assert by["de"].purity > 0.8 > 0.2 > by["fr"].purity
    assert {by[k].verdict for k in ("fr", "it")} == {"allow"}
    again = urls.judge(df.union(df).limit(0))
    assert again.count() == 0


def brute_templates(rows):
    """{path: template} of (path, n, labelled, blocked) rows of one host, by recursion."""
    out = {}

    def differs(a1, n1, a2, n2):
        if not n1 or not n2 or not n1 + n2:
            return False
        p = (a1 + a2) / (n1 + n2)
        return abs(a1 / n1 - a2 / n2) > urls.Z * (p * (1 - p) * (1 / n1 + 1 / n2)) ** 0.5

    def grow(rows, level, template):
        by = {}
        for r in rows:
            segs = r[0].removeprefix("/").split("/")
            if len(segs) <= level:
                out[r[0]] = template
            else:
                by.setdefault(segs[level], []).append(r)
        n, l, b = (sum(r[i] for rs in by.values() for r in rs) for i in (1, 2, 3))
        named = {}
        for seg, rs in by.items():
            own_l, own_b = (sum(r[i] for r in rs) for i in (2, 3))
            name = "*" if len(by) >= urls.VALUES and len(by) > urls.SHARE * n else \
                "~" if len(by) > 1 and not differs(own_b, own_l, b - own_b, l - own_l) else seg
            named.setdefault(name, []).extend(rs)
        for name, rs in named.items():
            grow(rs, level + 1, template + "/" + name)

    grow(rows, 0, "")
    return out


def test_tree_is_brute_force_at_any_depth(spark):
    rng = np.random.default_rng(4)
    paths = {"/" + "/".join(rng.choice(["a", "b", "c", ""] if rng.random() < 0.7 else [
        f"v{i}" for i in range(40)]) for _ in range(rng.integers(1, 9))) for _ in range(500)}
    paths |= {f"/a/b/c/d/e/{k}/{i}" for k in ("good", "bad") for i in range(30)} | {"/" + "z/" * 200}
    rows = [(p, 2, 2, 2 if "/b" in p else 0) if i % 3 else (p, 2, 0, 0)
            for i, p in enumerate(sorted(paths))]
    df = spark.createDataFrame([("h", *r) for r in rows],
                               "host string, path string, n long, labelled long, blocked long")
    got = {r.path: r.template for r in urls.templates(df).collect()}
    assert got == brute_templates(rows)
    labels = df.where("labelled > 0").select("host", "path", F.when(
        F.col("blocked") > 0, "block").otherwise("allow").alias("verdict"))
    judged = urls.judge(df.select(F.monotonically_increasing_id().alias("page_id"),
                                  F.concat(F.lit("http://h"), "path").alias("url")), (), labels).collect()
    labelled = {p for p, _, l, _ in rows if l}
    told = {r.template for r in judged if r.path in labelled}
    assert {r.path for r in judged} == got.keys()
    assert all(r.template in told for r in judged if r.verdict == "block")


def test_labelled_templates_are_rejected(spark):
    rows = [(i, f"http://h.net/spam/{i}") for i in range(40)] + [
        (i, f"http://h.net/good/{i}") for i in range(40, 80)]
    labels = spark.createDataFrame(
        [("h.net", f"/spam/{i}", "block") for i in range(12)]
        + [("h.net", f"/good/{i}", "allow") for i in range(40, 52)],
        "host string, path string, verdict string")
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), (), labels).collect()
    assert all((r.verdict == "block") == r.path.startswith("/spam/") for r in got)
