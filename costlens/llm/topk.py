"""Exact top-k inner products by no-random-access aggregation, in blocks.

Candidates are dealt into blocks, queries into groups, and every (block, group) pair
is one small task. In a block each component is a sorted list; a query reads it from
its end of larger contributions. Reading goes in steps of a shared depth. After each
step a candidate's lower bound adds up what has been read, and the worst that the
rest of each list allows; its upper bound adds the value last read. A candidate
below the k-th lower bound is out; when few are left their scores are resolved by
reading on. All bounds are matrix products over whole blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from costlens.llm.tables import only, prepare, stage

BLOCK, GROUP, TILE = 4096, 2048, 256
DEPTHS = (0.25, 0.75)


def vectors(df: DataFrame, key: str, column: str, scale: float) -> DataFrame:
    """(id, dim, v): floor(scale * x) of usable vectors, equal rows once.

    Null vectors and those that hold a null or a value that is not finite are left out.
    """
    x = F.transform(F.col(f"`{column}`"), lambda v: v.cast("double"))
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(f"`{key}`").alias("id"), x.alias("x")).where(
        F.col("x").isNotNull() & usable & F.col("id").isNotNull())
    return rows.select("id", F.size("x").alias("dim"), F.transform(
        "x", lambda v: F.floor(v * scale).cast("long")).alias("v")).distinct()


class Lists:
    """A block's sorted lists, one for each component."""

    def __init__(self, block: np.ndarray, dtype):
        self.v = block.astype(dtype)
        self.order = np.argsort(block, axis=0, kind="stable")
        self.place = np.empty_like(self.order)
        np.put_along_axis(self.place, self.order, np.arange(len(block))[:, None], axis=0)
        self.sorted = np.take_along_axis(self.v, self.order, axis=0)

    def bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries x candidates) after `depth` reads of each list."""
        n = len(self.v)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        tops, tails = self.place >= n - depth, self.place < depth
        read = up @ (self.v * tops).T + down @ (self.v * tails).T
        last_top, last_tail = self.sorted[n - depth], self.sorted[depth - 1]
        far_top, far_tail = self.sorted[0], self.sorted[-1]
        unread_top, unread_tail = (~tops).astype(self.v.dtype), (~tails).astype(self.v.dtype)
        upper = read + (up * last_top) @ unread_top.T + (down * last_tail) @ unread_tail.T
        lower = read + (up * far_top) @ unread_top.T + (down * far_tail) @ unread_tail.T
        return lower, upper


def exact_type(queries: np.ndarray, block: np.ndarray):
    """The fastest type in which every sum of products is exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) \
        * max(1, queries.shape[1])
    return np.float32 if most < 2 ** 23 else np.float64 if most < 2 ** 52 else np.int64


def top_of_block(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
                 k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate place, score) of each query's k best in a block."""
    kind = exact_type(queries, block)
    lists, n = Lists(block, kind), len(ids)
    out = []
    for t in range(0, len(queries), TILE):
        q = queries[t:t + TILE].astype(kind)
        own = query_ids[t:t + TILE, None] == ids[None, :]
        alive = ~own
        for share in DEPTHS:
            depth = max(1, int(n * share))
            lower, upper = lists.bounds(q, depth)
            # no candidate is certain to be worse than the smallest number
            floor = np.where(alive, lower, np.iinfo(np.int64).min if kind is np.int64 else -np.inf)
            if n > k:
                kth = np.partition(floor, n - k, axis=1)[:, n - k]
                alive &= upper >= kth[:, None]
            if alive.sum() <= 4 * k * len(q):
                break
        row, at = np.nonzero(alive)
        if len(row) * 4 > alive.size:
            score = (q @ lists.v.T)[row, at]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", q[row[i:i + 65536]], lists.v[at[i:i + 65536]])
                                    for i in range(0, len(row), 65536)] or [np.zeros(0, kind)])
        best = np.lexsort((ids[at], -score, row))
        row, at, score = row[best], at[best], score[best]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < k
        out.append((row[keep] + t, at[keep], score[keep].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def top_k(candidates: DataFrame, queries: DataFrame, key: str = "vec_id",
          column: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, id, score): each query's k highest inner products.

    Rows with the query's own id are no candidates; ties go to the smaller id; fewer
    candidates give fewer rows. Vectors meet those of their own length only; unusable
    ones (see `vectors`) take no part; rows repeated with id and vector count once.
    Other columns are ignored; an empty side gives no rows.
    """
    prepare(candidates.sparkSession)
    held = stage(vectors(only(candidates, key, column), key, column, scale), "candidates")
    asked = stage(vectors(only(queries, key, column), key, column, scale), "queries")
    blocks, groups = max(1, -(-held.count() // BLOCK)), max(1, -(-asked.count() // GROUP))
    spread = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = held.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    if groups > 1:
        left = left.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    else:
        left = left.withColumn("grp", F.lit(0))
    right = asked.withColumn("grp", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int")) \
        .withColumn("block", F.explode(spread))
    kind = held.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, query array<bigint>, id {kind}, score long"

    def search(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "query": [], "id": [], "score": []})
        c = c.sort_values("id", kind="stable")
        row, at, score = top_of_block(c["id"].to_numpy(), np.stack(c["v"].to_numpy()),
                                      q["id"].to_numpy(), np.stack(q["v"].to_numpy()), k)
        return pd.DataFrame({"query_id": q["id"].to_numpy()[row], "query": q["v"].to_numpy()[row],
                             "id": c["id"].to_numpy()[at], "score": score})

    found = (left.groupBy("dim", "block", "grp").cogroup(right.groupBy("dim", "block", "grp"))
             .applyInPandas(search, schema))
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))
