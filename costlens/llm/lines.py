"""Cross-site boilerplate: lines seen on many sites, by HyperLogLog spread.

A corpus also loses passages: lines of over fifty words that another document holds,
on whatever site.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from costlens.llm.quality import let
from costlens.llm.tables import prepare

LG_K = 12
#: Relative standard error of a sketch with 2**LG_K registers.
ERROR = 1.04 / 2 ** (LG_K / 2)
ANY_WORD, THREE_WORDS, PASSAGE = "[^ ]", "[^ ]+ +[^ ]+ +[^ ]", "^ *(?:[^ ]+ +){50}[^ ]"


class Spread(NamedTuple):
    """Sites that make lines of one or two words, and of three to fifty, boilerplate, and
    documents that make longer ones a repeated passage; None counts no such lines."""
    words: int | None
    line: int
    passage: int | None


#: Three sites are more than a copy and its original; two words alone say little.
CORPUS = Spread(words=10, line=3, passage=2)


def line_key(line: Column, least: Spread) -> Column:
    """Struct of a trimmed line's 64-bit hash, its threshold and whether it is a passage;
    null for a line that does not count."""
    def key(n: int, passage: bool) -> Column:
        return F.struct(F.xxhash64(F.trim(line)).alias("line"), F.lit(n).alias("least"),
                        F.lit(passage).alias("passage"))
    out = F.when(line.rlike(THREE_WORDS), key(least.line, False))
    if least.passage is not None:
        out = F.when(line.rlike(PASSAGE), key(least.passage, True)).otherwise(out)
    return out if least.words is None else F.coalesce(
        out, F.when(line.rlike(ANY_WORD), key(least.words, False)))


def keyed(docs: DataFrame, site: str, text: str, least: Spread) -> DataFrame:
    """(doc_id, text_hash, site, pos, line, least): the counted lines of every row.

    A passage's site is its document.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keys = F.transform(F.split(t, "\n", -1), lambda x: line_key(x, least))
    rows = docs.select(F.col("doc_id"), F.xxhash64(t).alias("text_hash"),
                       F.coalesce(F.col(f"`{site}`").cast("string"), F.lit("")).alias("_at"),
                       F.posexplode(keys).alias("pos", "key"))
    place = F.concat_ws(":", F.lit("document"), F.col("doc_id").cast("string"),
                        F.col("text_hash").cast("string"))
    return rows.where(F.col("key").isNotNull()).select(
        "doc_id", "text_hash", F.when(F.col("key.passage"), place).otherwise(F.col("_at")).alias("site"),
        "pos", "key.line", "key.least")


def spread_lines(rows: DataFrame) -> DataFrame:
    """(line, first): lines on at least `least` sites, with their first place.

    A sketch of the sites per line merges across tasks like a sum, so a line that
    every page carries costs a few hundred bytes a task. Estimates within five
    standard errors (and one site) of the threshold are replaced by exact counts; a
    threshold of two needs only the smallest and the largest site.
    """
    lines = rows.groupBy("line", "least").agg(
        F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count(F.lit(1)).alias("n"),
        F.min("site").alias("low"), F.max("site").alias("high"),
        F.min(F.struct("doc_id", "text_hash", "pos")).alias("first"))
    lines = lines.where(F.col("n") >= F.col("least")).select(
        "line", "least", "first", "low", "high", F.hll_sketch_estimate("sketch").alias("sites"))
    pair = lines.where((F.col("least") == 2) & (F.col("low") < F.col("high")))
    margin = F.greatest(F.lit(1.0), 5 * ERROR * F.col("least"))
    more = lines.where(F.col("least") != 2).withColumn("over", F.col("sites") - F.col("least"))
    sure = more.where(F.col("over") > margin)
    near = more.where(F.abs("over") <= margin)
    exact = (rows.where(F.col("least") != 2).select("line", "least", "site").distinct()
             .join(near.select("line"), "line", "left_semi")
             .groupBy("line", "least").agg(F.count(F.lit(1)).alias("sites"))
             .where(F.col("sites") >= F.col("least")))
    return sure.select("line", "first").union(pair.select("line", "first")).union(
        near.join(exact.select("line"), "line", "left_semi").select("line", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = 10, site: str = "source",
                text: str = "text", spread: Spread | None = None) -> DataFrame:
    """`docs` with boilerplate lines cut from `text`, and `_n_lines`, `_n_removed`.

    A line (trimmed, three words or more) on `min_sites` distinct sites or more
    stays only in its first place: smallest doc_id, then place in the text. `spread`
    sets thresholds by length instead, also for shorter lines and for passages. All
    other lines keep their order. A null text stays null and has no lines; a null
    site is a site of its own; rows equal in doc_id and text are treated alike; a
    text that loses every line becomes empty, its row stays. Other columns pass
    through (names that begin with an underscore are reserved).
    """
    prepare(docs.sparkSession)
    rows = keyed(docs, site, text, spread or Spread(None, min_sites, None))
    found = spread_lines(rows).withColumnRenamed("line", "_line")
    elsewhere = ~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("first"))
    # Spark sizes unpacked lines by the texts they came in; a semi join never broadcasts them
    places = (rows.join(found, (F.col("line") == F.col("_line")) & elsewhere, "left_semi")
              .select("doc_id", "text_hash", "pos").distinct()
              .groupBy("doc_id", "text_hash").agg(F.collect_list("pos").alias("_gone"))
              .select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_gone"))
    t = F.col(f"`{text}`")
    named = docs.withColumn("_key", F.xxhash64(F.coalesce(t, F.lit(""))))
    joined = named.join(places, F.col("doc_id").eqNullSafe(F.col("_doc"))
                        & (F.col("_key") == F.col("_hash")), "left")

    def kept(parts: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
        return F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")

    lines = F.split(t, "\n", -1)
    clean = F.when(F.col("_gone").isNull(), t).otherwise(let(lines, kept))
    out = joined.withColumns({
        "_n_lines": F.when(t.isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "_n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"), text: clean})
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "_n_lines",
                      F.greatest("_n_removed", F.lit(0).cast("long")).alias("_n_removed"))
