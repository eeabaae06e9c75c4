"""A Merkle manifest of a dataset: content-addressed records, proofs by descent, folding.

Rows are leaves, ordered by key within their group (a language, say); pairs of
consecutive nodes are hashed into their parent until one is left, the group's root, and
the groups' roots are hashed into one root in the same way.

The store is content-addressed: a record's key is a digest, and its content is what the
digest covers. A record holds HEIGHT levels of a tree at once (a page of at most
2**HEIGHT consecutive nodes and all digests above them), so that a lookup resolves
HEIGHT rank digits and a tree of 10**10 leaves takes five rounds. Pages of the lowest
level are built from leaves that are dealt out by range, so no task holds a group.

A request (group, rank) descends from the root. Requests below one page share one lookup
of it: level by level the distinct pages that are asked for are joined with the store by
digest, the rank's digits choose the child, and the children not chosen are the proof.
Segments come from the root down and are put together the other way round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from costlens.llm.tables import prepare, stage

#: Levels of one record: 256 nodes and those above them, some 40 KB.
HEIGHT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TRAIL = "array<struct<sibling string, right boolean>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of concatenated texts; a null part makes it null."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def written(value: Column) -> Column:
    """A field as a leaf holds it: `-` for null, else its UTF-8 length, `:` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text.cast("binary")).cast("string"), F.lit(":"), text),
                      F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(*map(written, fields))


def group_key(group: Column) -> Column:
    """A text never null that sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows` with `rank`, their place (from 0) in their `grp` by `order`, and `n`, its size.

    Rows are dealt out by range and numbered where they lie; only one count per group
    and partition is summed up. Rows equal in all of `order` are told apart by where
    they are read, so repeats of one row cannot fill a task.
    """
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    order = ("grp", *order, "_tie")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    runs = placed.groupBy("grp", part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = W.partitionBy("grp")
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select("grp", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
                       F.sum("_n").over(whole).alias("n"))
    return (placed.withColumn("_part", part).join(runs, ["grp", "_part"])
            .withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"))


def _above(level: Column) -> Column:
    """Parents of a level's nodes: every two, and a last one alone."""
    places = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(places, lambda i: digest(
        F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))))


@dataclass
class Tree:
    """`pages[j]`: records (digest, levels) of the j-th round from the leaves; `tops`:
    (grp, digest, round) of every group, the round being that of its last record."""

    pages: list[DataFrame]
    tops: DataFrame


def build(nodes: DataFrame) -> Tree:
    """The trees over (grp, rank, n, digest): one for each group of n nodes."""
    pages, tops, j = [], None, 0
    while True:
        height = F.least(F.ceil(F.log2("n")).cast("int"), F.lit(HEIGHT))
        page = (nodes.groupBy("grp", "n", F.shiftright("rank", HEIGHT).alias("page"))
                .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "digest"))),
                                 lambda x: x["digest"]).alias("base")))
        steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(
            F.array().cast("array<int>"))
        levels = F.aggregate(steps, F.array("base"), lambda levels, _: F.concat(
            levels, F.array(_above(F.element_at(levels, -1)))))
        page = stage(page.select("grp", "n", "page", levels.alias("levels")).withColumn(
            "digest", F.element_at(F.element_at("levels", -1), 1)), f"manifest-{j}")
        pages.append(page.select("digest", "levels").dropDuplicates(["digest"]))
        done = page.where(F.col("n") <= 1 << HEIGHT).select("grp", "digest", F.lit(j).alias("round"))
        tops = done if tops is None else tops.union(done)
        nodes = page.where(F.col("n") > 1 << HEIGHT).select(
            "grp", F.col("page").alias("rank"), "digest",
            F.ceil(F.col("n") / (1 << HEIGHT)).cast("long").alias("n"))
        if nodes.isEmpty():
            return Tree(pages, tops)
        j += 1


def _segment(levels: Column, digit: Column) -> Column:
    """Children not chosen on the way from a record's digest to node `digit` of its
    lowest level, from below; a node that is alone in its run has a null one."""
    heights = F.when(F.size(levels) > 1, F.sequence(F.lit(0), F.size(levels) - 2)).otherwise(
        F.array().cast("array<int>"))

    def at(height: Column) -> Column:
        place = F.floor(digit / F.pow(F.lit(2.0), height)).cast("int")
        return F.struct(F.get(F.get(levels, height), place.bitwiseXOR(F.lit(1))).alias("sibling"),
                        (place % 2 == 0).alias("right"))

    return F.transform(heights, at).cast(TRAIL)


def descend(tree: Tree, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """`requests` with `digest` (the node they ask for) and `trail` (the children not
    chosen, from the node upwards, before the start's own trail), and `starts`' columns.

    `requests` has (grp, rank) and any others; `starts` has (grp, digest, round, trail)
    and any others that are constant for a group. A request outside the tree has no row.
    """
    parent = F.shiftright("rank", HEIGHT)
    asked = [requests]
    for _ in tree.pages[1:]:
        asked.append(asked[-1].select("grp", parent.alias("rank")).distinct())
    others = [c for c in starts.columns if c not in ("grp", "digest", "round", "trail")]
    found = None
    for j in reversed(range(len(tree.pages))):
        at = starts.where(F.col("round") == j).select(
            "grp", F.lit(0).cast("long").alias("page"), "digest", "trail", *others)
        if found is not None:
            at = at.unionByName(found.select("grp", F.col("rank").alias("page"), "digest", "trail",
                                             *others))
        records = at.join(tree.pages[j], "digest").drop("digest")
        digit = F.col("rank").bitwiseAND(F.lit((1 << HEIGHT) - 1)).cast("int")
        found = (asked[j].withColumn("page", parent).join(records, ["grp", "page"])
                 .withColumn("digest", F.get(F.get("levels", F.lit(0)), digit))
                 .withColumn("trail", F.concat(_segment(F.col("levels"), digit), F.col("trail")))
                 .where("digest IS NOT NULL").drop("levels", "page"))
        if j:
            found = stage(found, "descent")
    return found


def fold(start: Column, trail: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(trail, start, lambda at, s: F.when(
        s["sibling"].isNull(), digest(at)).when(
        s["right"], digest(at, s["sibling"])).otherwise(digest(s["sibling"], at)))


def proof(trail: Column) -> Column:
    """Digest of a proof's siblings, from the leaf up."""
    return digest(F.array_join(F.transform(trail, lambda s: s["sibling"]), ""))


@dataclass
class Manifest:
    """`leaves`: (grp, rank, n, key, digest and further columns); `groups`: every group's
    root with its own proof; `tree`: the groups' trees."""

    leaves: DataFrame
    groups: DataFrame
    tree: Tree


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang",
             fields: tuple[str, ...] = FIELDS, **more: Column) -> Manifest:
    """The manifest of all rows of `docs`; `more` are further columns of its leaves.

    Leaves ascend by key (null first), those of one key by digest; a repeated row is a
    leaf each time. Groups ascend by their name's UTF-8 bytes, null first. Columns that
    are not named are ignored, whatever their names; texts are hashed whole. No rows:
    no leaves and no root.
    """
    prepare(docs.sparkSession)
    rows = docs.select(group_key(F.col(f"`{group}`")).alias("grp"), F.col(f"`{key}`").alias("key"),
                       leaf([F.col(f"`{f}`") for f in fields]).alias("digest"),
                       *[c.alias(n) for n, c in more.items()])
    leaves = stage(ranked(rows, F.col("key").asc_nulls_first(), F.col("digest")), "leaves")
    tree = build(leaves.select("grp", "rank", "n", "digest"))
    subs = tree.tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest", "round")
    subs = stage(ranked(subs, F.col("name")), "groups")
    top = build(subs.select("grp", "rank", "n", "digest"))
    starts = top.tops.select("grp", "digest", "round", F.array().cast(TRAIL).alias("trail"),
                             F.col("digest").alias("root"))
    found = descend(top, starts, subs.select("grp", "rank", "name", F.col("round").alias("own_round")))
    groups = found.select(F.col("name").alias("grp"), "digest", F.col("own_round").alias("round"),
                          "trail", F.col("digest").alias("subroot"), "root")
    return Manifest(leaves, stage(groups, "subroots"), tree)


def prove(m: Manifest, requests: DataFrame) -> DataFrame:
    """Every request (grp, rank, any others) with `digest` (its leaf), `trail` (its proof up
    to the root), `subroot` and `root`."""
    return descend(m.tree, m.groups, requests)
