"""A training corpus from `documents`: rules, lines, near duplicates, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from costlens import session
from costlens.llm import lines, mixing, packing, quality, queries, simhash
from costlens.llm.tables import prepare, table

#: Parts of their present tokens that the domains should hold after mixing.
KEPT = {"good": 1.0, "poor": 0.1, "toxic": 0.1}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that several sites and passages that several documents
    share (their first place keeps them)."""
    return lines.dedup_lines(docs, spread=lines.CORPUS).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints of three-word shingles at most three bits
    apart link: the smallest id's."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates that meet the domains' targets say."""
    model = mixing.fit(docs, queries.domains_of(table(spark, sf_dir, "labels")))
    return mixing.resample(docs, model, {d: KEPT[d] for d in model.domains if d in KEPT}, "domain")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences along the curve, with their ids."""
    return packing.pack(docs, queries.vocabulary_file(queries.BYTE_BPE), queries.BYTE_IDS)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup),
          ("simhash_near_dedup", near_dedup), ("mixing", mixture), ("packing", sequences)]

#: Fingerprints, classifier and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = session.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
