"""Isolation forest per group: bounded fit, distributed scoring.

A tree needs only a few hundred rows; each tree draws its own from all rows of the
group, by hash. Scoring pairs chunks of a group's rows with a
copy of its trees, so no task holds a group and nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from costlens import constants as C
from costlens.operators.dedup import with_group_count
from costlens.schemas import with_fields

#: Trees grown together by one task.
TREES_PER_TASK = 25
CHUNK_ROWS = 100_000


def draws(df: DataFrame, groups: list[str], identity: list[str], trees: int,
          size: int = C.FOREST_SUBSAMPLE, seed: int = C.FOREST_SEED) -> DataFrame:
    """Rows of every tree's subsample: (groups…, other columns, tree), `size` per tree.

    A group's rows are dealt out among as many trees as leaves each at least half as
    many again as it needs; further deals, with other hashes, serve the rest. Every
    row can be in any tree, a row is repeated once per deal only, and a tree keeps
    the rows of smallest hash. A group that is too small to deal gives all its rows
    to each tree. Nothing but the group's count is needed beforehand.
    """
    wide = F.greatest(F.lit(1), F.floor(F.col("group_rows") / F.lit(1.5 * size)).cast("int"))

    def place(deal: Column, salt: int) -> Column:
        return F.xxhash64(F.lit(seed + salt), deal, *identity)

    deals = F.sequence(F.lit(0), F.ceil(F.lit(trees) / wide).cast("int") - 1)
    dealt = F.transform(deals, lambda d: F.struct(
        (d * wide + F.pmod(place(d, 0), wide)).cast("int").alias("tree"), place(d, 1).alias("u")))
    rows = (with_group_count(df, groups)
            .withColumn("_draw", F.explode(F.filter(dealt, lambda x: x["tree"] < trees)))
            .select("*", F.col("_draw.tree").alias("tree"), F.col("_draw.u").alias("_u")))
    w = W.partitionBy(*groups, "tree").orderBy("_u", *identity)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size).drop(
        "_rn", "_u", "_draw")


def average_path(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    out = 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def _grow(rows: np.ndarray, tree: np.ndarray, depth: int, rng) -> tuple[np.ndarray, ...]:
    """Trees as heaps, grown together level by level, from the rows of each.

    Per node: split column (-1 at a leaf), split value, path length at a leaf.
    """
    size, trees = 2 ** (depth + 1) - 1, int(tree.max()) + 1
    column = np.full((trees, size), -1)
    value, path = np.zeros((trees, size)), np.zeros((trees, size))
    node = np.zeros(len(rows), dtype=int)
    live = np.arange(len(rows))
    for level in range(depth + 1):
        key = tree[live] * size + node[live]
        order = np.argsort(key, kind="stable")
        live = live[order]
        nodes, start, count = np.unique(key[order], return_index=True, return_counts=True)
        if not len(nodes):
            break
        low = np.minimum.reduceat(rows[live], start)
        high = np.maximum.reduceat(rows[live], start)
        usable = high > low
        inner = usable.any(axis=1) & (count > 1) & (level < depth)
        at = np.arange(len(nodes))
        c = np.where(usable, rng.random(usable.shape), -1.0).argmax(axis=1)
        v = low[at, c] + rng.random(len(nodes)) * (high - low)[at, c]
        t, n = nodes // size, nodes % size
        column[t[inner], n[inner]], value[t[inner], n[inner]] = c[inner], v[inner]
        path[t[~inner], n[~inner]] = level + average_path(count[~inner])
        mine = np.repeat(at, count)
        node[live] = 2 * node[live] + 1 + (rows[live, c[mine]] > v[mine])
        live = live[inner[mine]]
    return column, value, path


def fit_forest(df: DataFrame, groups: list[str], columns: list[str], identity: list[str],
               trees: int = C.FOREST_TREES, subsample: int = C.FOREST_SUBSAMPLE,
               min_rows: int = C.MIN_ROWS["iforest"], seed: int = C.FOREST_SEED) -> DataFrame:
    """One row per (group, tree) with the tree's arrays."""
    drawn = draws(df, groups, identity, trees, subsample, seed).where(
        F.col("group_rows") >= min_rows)
    drawn = drawn.select(*groups, *columns, "tree", F.floor(
        F.col("tree") / TREES_PER_TASK).cast("int").alias("block"))
    schema = with_fields(df, groups, "tree int, psi int, split_column array<int>, "
                                     "split_value array<double>, path array<double>")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x, tree = pdf[columns].to_numpy(float), pdf["tree"].to_numpy()
        order = np.lexsort([*x.T[::-1], tree])
        names, local, psi = np.unique(tree[order], return_inverse=True, return_counts=True)
        depth = max(1, int(np.ceil(np.log2(psi.max()))))
        grown = _grow(x[order], local, depth, np.random.default_rng([seed, int(names[0])]))
        key = list(pdf.loc[pdf.index[0], groups])
        return pd.DataFrame([[*key, t, n, c, v, p] for t, n, c, v, p in zip(names, psi, *grown)],
                            columns=[f.name for f in schema])

    return drawn.groupBy(*groups, "block").applyInPandas(build, schema)


def _scores(x: np.ndarray, model: pd.DataFrame) -> np.ndarray:
    """Outlier score 2^(-mean path / c(psi)) per row."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for c, v, p in zip(model["split_column"], model["split_value"], model["path"]):
        c, v, p = np.asarray(c), np.asarray(v), np.asarray(p)
        node = np.zeros(len(x), dtype=int)
        for _ in range(int(np.log2(len(c) + 1)) - 1):
            inner = c[node] >= 0
            right = x[rows, np.maximum(c[node], 0)] > v[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        total += p[node]
    return 2.0 ** (-(total / len(model)) / average_path(model["psi"].iloc[0]))


def score_forest(df: DataFrame, model: DataFrame, groups: list[str], columns: list[str],
                 spread_on: list[str], out: str = "outlier_score") -> DataFrame:
    """`df` with its outlier score; NULL where the group has no forest."""
    counted = with_group_count(df, groups, "_rows")
    chunks = F.ceil(F.col("_rows") / F.lit(CHUNK_ROWS))
    rows = counted.withColumn("_chunk", F.pmod(F.xxhash64(*spread_on), chunks)).drop("_rows")
    per_group = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"))
    copies = model.join(per_group, groups).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1))).drop("_rows")
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])
    names = [f.name for f in schema]

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) and len(right):
            left[out] = _scores(left[columns].to_numpy(float), right)
        else:
            left[out] = None
        return left[names]

    key = [*groups, "_chunk"]
    return rows.groupBy(*key).cogroup(copies.groupBy(*key)).applyInPandas(score, schema)


def score_ranges(scored: DataFrame, groups: list[str], column: str) -> DataFrame:
    return scored.groupBy(*groups).agg(F.min(column).alias("score_min"),
                                       F.max(column).alias("score_max"))
