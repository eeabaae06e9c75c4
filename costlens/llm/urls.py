"""URL filter: explicit rules, then a path-template tree judged by labelled purity.

Per host, paths form a tree of segments. Level by level, a position whose values are
mostly different becomes a wildcard, and branches whose labelled share does not
differ from their siblings' merge into one. A leaf is a template; it is rejected when
its blocked share, smoothed towards its host's and that towards all labels', is high.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from costlens.llm.tables import only, prepare, stage

#: A position is variable with this many values, and more than this share of its urls.
VALUES, SHARE = 8, 0.25
#: Two-sided 5 % point of the normal distribution; weight of a prior, in labels.
Z, PRIOR = 1.96, 4.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NAMED = "://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    """`text` is a host suffix and a path prefix, as in example.org/en/."""
    verdict: str
    text: str


#: The rules of the registered query.
RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"),
         Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, NAMED, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, NAMED, 2), F.lit(""))


def longest_rule(rules: tuple[Rule, ...]) -> Column:
    """Struct of verdict and text of the longest rule that fits host and path, or null."""
    out = F.lit(None).cast("struct<verdict:string,text:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text.find("/"), r)):
        host, slash, path = rule.text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) \
            & F.col("path").startswith(slash + path)
        out = F.when(fits, F.struct(F.lit(rule.verdict).alias("verdict"),
                                    F.lit(rule.text).alias("text"))).otherwise(out)
    return out


def similar(a1: Column, n1: Column, a2: Column, n2: Column) -> Column:
    """Whether two labelled shares, a1 of n1 and a2 of n2, do not differ significantly."""
    pooled = (a1 + a2) / F.nullif(n1 + n2, F.lit(0))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(n1, F.lit(0)) + 1 / F.nullif(n2, F.lit(0))))
    return F.coalesce(F.abs(a1 / F.nullif(n1, F.lit(0)) - a2 / F.nullif(n2, F.lit(0)))
                      <= Z * error, F.lit(True))


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, template): every distinct path's place in the tree.

    `paths` has host, path, n (urls), labelled and blocked. Only counts by branch are
    shuffled, never a host's urls as a group; each level is written before the next.
    Levels follow until every branch is at its end or holds one path, which keeps its
    further segments as they are: there are as many as the longest shared beginning has.
    """
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    columns = ["host", "path", "n", "labelled", "blocked", "template"]
    nodes = stage(paths.select("*", F.when(F.col("path") != "", segments).alias("segs"),
                               F.lit("").alias("template"), F.lit(False).alias("open")).withColumn(
        "open", F.col("segs").isNotNull()), "urls")
    done, level = nodes.where(~F.col("open")).select(columns), 0
    while not nodes.where("open").isEmpty():
        here = nodes.where("open").withColumn("seg", F.get("segs", F.lit(level)))
        child = here.groupBy("host", "template", "seg").agg(F.count(F.lit(1)).alias("paths"), *sums)
        parent = child.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("values"), *[F.sum(c).alias(f"all_{c}") for c in
                                                 ("n", "labelled", "blocked")])
        both = child.join(parent, ["host", "template"])
        variable = (F.col("values") >= VALUES) & (F.col("values") > SHARE * F.col("all_n"))
        alike = similar(F.col("blocked"), F.col("labelled"), F.col("all_blocked") - F.col("blocked"),
                        F.col("all_labelled") - F.col("labelled"))
        name = F.when(variable, F.lit("*")).when(alike & (F.col("values") > 1), F.lit("~")).otherwise(
            F.col("seg"))
        names = both.withColumn("name", name)
        held = names.groupBy("host", "template", "name").agg(F.sum("paths").alias("held"))
        names = names.select("host", "template", "seg", "name").join(
            held, ["host", "template", "name"])
        rest = F.slice("segs", F.lit(level + 2), F.greatest(F.size("segs") - level - 1, F.lit(0)))
        ended, alone = F.size("segs") <= level + 1, F.col("held") == 1
        nodes = stage(here.join(names, ["host", "template", "seg"]).select(
            "host", "path", "n", "labelled", "blocked", "segs", F.concat(
                "template", F.lit("/"), "name", F.when(alone & ~ended, F.concat(
                    F.lit("/"), F.array_join(rest, "/"))).otherwise(F.lit(""))).alias("template"),
            (~ended & ~alone).alias("open")), "urls")
        done, level = done.unionByName(nodes.where(~F.col("open")).select(columns)), level + 1
    return done


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labels: DataFrame | None = None,
          reject: float = 0.6, key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) for every row of `pages`.

    The rules decide where one fits, and their verdicts are the labels the tree
    learns from, with those of `labels` (host, path, verdict) if given. A null url or
    one without "://" has empty host and path. Repeated rows count as often as they
    occur and are judged alike; a template without labels of its own is allowed, whatever
    its host's share; other columns are ignored; no rows give none.
    """
    prepare(pages.sparkSession)
    rows = only(pages, key, "url").select(F.col(f"`{key}`"), host_of(F.col("url")).alias("host"),
                                          path_of(F.col("url")).alias("path"))
    counts = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "fit", longest_rule(rules))
    given = F.col("fit.verdict")
    if labels is not None:
        more = labels.groupBy("host", "path").agg(F.max("verdict").alias("told"))
        counts = counts.join(more, ["host", "path"], "left")
        given = F.coalesce(given, F.col("told"))
    counts = counts.select("host", "path", "n", F.when(given.isNotNull(), F.col("n")).otherwise(0)
                           .alias("labelled"), F.when(given == "block", F.col("n")).otherwise(0)
                           .alias("blocked"))
    nodes = templates(counts)
    sums = [F.sum("labelled").alias("l"), F.sum("blocked").alias("b")]
    every = nodes.agg(*sums).first()
    share = (every["b"] or 0) / every["l"] if every["l"] else 0.0
    hosts = nodes.groupBy("host").agg(*sums).select(
        "host", ((F.col("b") + PRIOR * share) / (F.col("l") + PRIOR)).alias("host_share"))
    leaves = nodes.groupBy("host", "template").agg(*sums).join(hosts, "host").select(
        "host", "template", F.col("l").alias("own"),
        ((F.col("b") + PRIOR * F.col("host_share")) / (F.col("l") + PRIOR)).alias("purity"))
    judged = nodes.select("host", "path", "template").join(leaves, ["host", "template"])
    verdict = F.when((F.col("own") > 0) & (F.col("purity") >= reject), F.lit("block")).otherwise(
        F.lit("allow"))
    judged = judged.select("host", "path", "template", "purity", verdict.alias("learnt"))
    out = rows.join(judged, ["host", "path"]).withColumn("fit", longest_rule(rules))
    return out.select(F.col(f"`{key}`"), "host", "path", F.col("fit.text").alias("rule"),
                      F.coalesce("fit.verdict", "learnt").alias("verdict"), "template", "purity")
