"""SimHash fingerprints and their links by multi-index hashing.

Fingerprints that differ in at most three bits link. Work is on distinct
fingerprints, in two steps whose groups cannot blow up:

1. Balls of radius one around whole fingerprints. Fingerprints that share a point
   differ in at most two bits, so all of them link to the smallest: a group of at
   most 65 gives at most 64 links, however many copies a document has.
2. Segments. Of two 32-bit halves one differs in at most one bit. Each fingerprint
   looks up the 33 points of the ball around each half among the halves of all
   others, and whole distances are verified. Only pairs of different groups of
   step 1 matter; a lookup is dropped when its own group is the largest in the
   bucket, because the others look that group up, so a bucket full of near copies
   is never paired with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from costlens.llm.components import components
from costlens.llm.encode import sliced
from costlens.llm.tables import dealt, only, prepare, stage

HALF, MASK = 32, (1 << 32) - 1
#: Signed 64-bit words with one bit set.
SINGLE = [1 << i if i < 63 else -(1 << 63) for i in range(64)]


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the 64-bit hashes."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for i in range(0, n, 1 << 16):
        part = np.unpackbits(hashes[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8),
                             axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fingerprint of every whole text as a signed long.

    A-Z are lower-cased; words are runs of anything but ASCII white space; shingles
    count with their repeats; a text of fewer words is one shingle; one of none
    (null and empty texts too) has fingerprint zero.
    """
    prepare(docs.sparkSession)
    rows = only(docs, "doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest
        for batch in sliced(batches):
            out = []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                split = (text or b"").lower().split()
                shingles = zip(*(split[i:] for i in range(min(words, len(split)))))
                hashes = np.fromiter((xxh64_intdigest(b" ".join(s), seed) for s in shingles),
                                     np.uint64)
                out.append(fingerprint_of(hashes) if len(hashes) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(out, np.uint64).view(np.int64))],
                ["doc_id", "fp"])

    return rows.mapInArrow(scan, schema)


def ball(x: Column, bits: list[int]) -> Column:
    """x and x with each one of `bits` flipped, as an array."""
    return F.transform(F.array(F.lit(0).cast("long"), *[F.lit(b).cast("long") for b in bits]),
                       lambda m: m.bitwiseXOR(x))


def close_links(fps: DataFrame) -> DataFrame:
    """Step 1: (a, b) links that connect all fingerprints at most two bits apart."""
    near = dealt(fps, "fp").select("fp", F.explode(ball(F.col("fp"), SINGLE)).alias("point"))
    groups = near.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    # a ball's members and its centre: the smallest links to each of the others
    return (groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
            .where("a <> b").distinct())


def segment_links(grouped: DataFrame, distance: int) -> DataFrame:
    """Step 2: (a, b) group pairs with fingerprints at most `distance` apart.

    `grouped` has (fp, component, size).
    """
    fp = F.col("fp")
    low, high = fp.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(fp, HALF)
    halves = F.array(F.struct(F.lit(0).alias("seg"), low.alias("value")),
                     F.struct(F.lit(1).alias("seg"), high.alias("value")))
    held = dealt(grouped, "fp").select("fp", "component", "size", F.explode(halves).alias("h")).select(
        "fp", "component", "size", "h.seg", "h.value")
    points = held.select("fp", "component", "size", "seg",
                         F.explode(ball(F.col("value"), SINGLE[:HALF])).alias("value"))
    # each bucket's largest group; most buckets hold one group and need no lookup of it
    top = held.groupBy("seg", "value").agg(F.max(F.struct("size", "component")).alias("top"))
    # Spark sizes an exploded table as if each row stayed one and would broadcast it: merge
    ask = (points.hint("merge").join(top, ["seg", "value"])
           .where(F.struct("size", "component") < F.col("top"))
           .select("seg", "value", fp.alias("x"), F.col("component").alias("a"),
                   F.struct("size", "component").alias("rank")))
    found = ask.join(held.hint("merge"), ["seg", "value"]).where(
        (F.struct("size", "component") > F.col("rank"))
        & (F.bit_count(F.col("x").bitwiseXOR(fp)) <= distance))
    return found.select("a", F.col("component").alias("b")).distinct()


def linked(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(fp, component): smallest fingerprint reachable, for those with a neighbour."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves with balls of radius one cover distances up to 3")
    fps = stage(fps.select("fp").distinct(), "fingerprints")
    if distance < 3:
        first = fps.select("fp", F.col("fp").alias("component"))
    else:
        tops = components(close_links(fps)).select(F.col("node").alias("fp"), "component")
        first = fps.join(tops, "fp", "left").select(
            "fp", F.coalesce("component", "fp").alias("component"))
    sizes = first.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    grouped = stage(first.join(sizes, "component").select("fp", "component", "size"), "groups")
    joined = components(segment_links(grouped, distance)).select(
        F.col("node").alias("component"), F.col("component").alias("whole"))
    return grouped.join(joined, "component", "left").select(
        "fp", F.coalesce("whole", "component").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`.

    component_id is the smallest doc_id that links reach; equal fingerprints link,
    whatever the texts. Repeated rows keep their rows; a null doc_id gets the
    smallest other id of its component or null. Extra columns are ignored; no rows
    give none.
    """
    fps = stage(fingerprints(docs, words), "documents-fp")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = stage(linked(fps, distance).join(first, "fp"), "linked")
    least = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    named = groups.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """`docs` with one row of each component: that of the smallest doc_id.

    Rows of one doc_id are told apart by their text's hash; an id's repeats in one
    component leave one row.
    """
    numbered = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    ids = only(numbered, "_row", "text").withColumnRenamed("_row", "doc_id")
    rows = near_duplicates(ids, words, distance).select(
        F.col("doc_id").alias("_row"), "component_id")
    keyed = numbered.select("_row", F.col("doc_id").alias("_id")).join(rows, "_row")
    kept = keyed.groupBy("component_id").agg(
        F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("k")).select("k._row")
    return numbered.join(kept, "_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
