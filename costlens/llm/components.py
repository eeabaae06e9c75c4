"""Connected components of a graph given as an edge table, in logarithmic rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from costlens.llm.tables import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Every round each node points at the smallest pointer among its neighbours'
    and at its pointer's pointer, so paths halve. Only (node, pointer) rows move;
    neighbours' minima are combined before the shuffle. State is written to the
    shared folder each round, so no lineage grows and no executor's loss matters.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    state = stage(both.groupBy("a").agg(F.min("b").alias("m"))
                  .select(F.col("a").alias("node"), F.least("a", "m").alias("top")), "component")
    while True:
        near = (both.join(state, F.col("b") == F.col("node"))
                .groupBy("a").agg(F.min("top").alias("near")))
        hooked = (state.join(near, state.node == near.a)
                  .select("node", F.col("top").alias("old"), F.least("top", "near").alias("new")))
        # a pointer's owner learns the smallest pointer of those that point at it
        told = hooked.groupBy(F.col("old").alias("at")).agg(F.min("new").alias("told"))
        hooked = hooked.join(told, F.col("node") == F.col("at"), "left").select(
            "node", "old", F.least("new", F.coalesce("told", "new")).alias("top"))
        hooked = stage(hooked, "component")
        above = hooked.select(F.col("node").alias("up"), F.col("top").alias("upper"))
        jumped = stage(hooked.join(above, F.col("top") == F.col("up"), "left").select(
            "node", "old", F.least("top", F.coalesce("upper", "top")).alias("top")), "component")
        state = jumped.select("node", "top")
        if jumped.where("old <> top").isEmpty():
            return state.withColumnRenamed("top", "component")
