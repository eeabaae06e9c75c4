"""Manifests beside a brute-force tree: every digest, proof and verdict."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from costlens.llm import merkle
from tests.llm.fixtures import no_documents, odd_documents


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}"
               for f in merkle.FIELDS])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path_of(levels, i):
    """(sibling or None, sibling is right) from the leaf up."""
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, i % 2 == 0))
        i //= 2
    return out


def brute(rows):
    """{(lang, leaf): sorted proofs} and the root."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        nodes = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0,
                                                    leaf_of(r)))
        trees[name] = levels_of([leaf_of(r) for r in nodes])
    top = levels_of([trees[n][-1][0] for n in names])
    found = []
    for at, name in enumerate(names):
        for i, d in enumerate(trees[name][0]):
            path = path_of(trees[name], i) + path_of(top, at)
            found.append((name, i, d, trees[name][-1][0], path))
    return found, top[-1][0]


def rows_of(docs):
    return [r.asDict() for r in docs.select(*merkle.FIELDS).collect()]


def check(docs):
    rows = rows_of(docs)
    want, root = brute(rows)
    m = merkle.manifest(docs)
    got = merkle.prove(m, m.leaves.select("grp", "rank")).withColumn(
        "folded", merkle.fold(F.col("digest"), F.col("trail"))).collect()
    mine = sorted((r.grp, r["rank"], r.digest, r.subroot, [tuple(s) for s in r.trail]) for r in got)
    assert mine == sorted(("-" if n is None else f"={n}", *rest) for n, *rest in want)
    assert {r.root for r in got} == {r.folded for r in got} == {root}
    return m


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest_is_the_brute_force_tree(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    docs = odd_documents(spark).withColumn("n_chars", F.length("text")).withColumn(
        "lang", F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("l"), F.col("doc_id") % 5)))
    check(docs)


def test_many_rounds(spark):
    docs = spark.range(1100).select(
        F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"),
        F.when(F.col("id") % 11 == 0, "é").when(F.col("id") == 1, "alone").otherwise("z").alias("lang"),
        F.lit(None).cast("string").alias("source"), F.lit(1).alias("n_chars"))
    m = check(docs)
    one = merkle.prove(m, spark.createDataFrame([("=z", 998, 5), ("=z", 5000, 5), ("=q", 0, 5)],
                                                "grp string, rank long, page int")
                       .withColumnRenamed("page", "mine"))
    assert [(r["rank"], r.mine) for r in one.collect()] == [(998, 5)]


def test_a_single_leaf_is_the_root(spark):
    docs = spark.createDataFrame([(None, None, None, None, None)],
                                 "doc_id long, source string, lang string, n_chars int, text string")
    m = check(docs)
    (r,) = merkle.prove(m, m.leaves.select("grp", "rank")).select(
        "root", merkle.proof(F.col("trail")).alias("p")).collect()
    assert r.root == h("-" * 5) and r.p == h("")


def test_no_rows(spark):
    m = merkle.manifest(no_documents(spark).withColumn("n_chars", F.lit(1)))
    assert merkle.prove(m, m.leaves.select("grp", "rank")).count() == 0


def test_a_changed_leaf_does_not_lead_to_the_root(spark):
    docs = odd_documents(spark).withColumn("n_chars", F.lit(3))
    m = merkle.manifest(docs, other=F.sha2(F.lit("x").cast("binary"), 256))
    folded = merkle.prove(m, m.leaves.select("grp", "rank", "other")).select(
        "root", merkle.fold(F.col("other"), F.col("trail")).alias("f"))
    assert folded.where("f = root").count() == 0 < folded.count()
