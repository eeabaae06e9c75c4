"""Terms of texts for small text models: choosing a vocabulary and counting it.

A term is a lower-cased run of letters, or its first four letters and a star, so
that word families count together. Words are cut at white space and each distinct
one is looked at once per batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from costlens.llm.encode import sliced
from costlens.llm.tables import only, stage

LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (4,)
#: Text looked at together: word tables of a larger part would fill a task's memory.
SLICE_BYTES = 2 << 20


def terms_of(word: str) -> list[str]:
    out = []
    for run in LETTERS.findall(word):
        out.append(run)
        out += [run[:k] + "*" for k in STEMS if len(run) > k]
    return out


class Words:
    """Words of a batch of texts: distinct ones, and (text, word, count) triples."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(pc.utf8_lower(
            pc.replace_substring_regex(texts, r"[\t\n\v\f\r]", " ")), " ")
        edges = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        self.distinct = coded.dictionary.to_pylist()
        word = coded.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(texts)), np.diff(edges))
        filled = np.array([bool(w) for w in self.distinct], bool)
        solid = filled[word] if len(word) else np.zeros(0, bool)
        self.rows = len(texts)
        self.total = np.bincount(row[solid], minlength=self.rows)
        key, self.count = np.unique(row[solid] * max(1, len(self.distinct)) + word[solid],
                                    return_counts=True)
        self.row, self.word = np.divmod(key, max(1, len(self.distinct)))


class Counter:
    """Counts of a fixed vocabulary in batches of texts."""

    def __init__(self, vocabulary: list[str]):
        self.place = {t: i for i, t in enumerate(vocabulary)}
        self.size = len(vocabulary)

    def count(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) triples in row order."""
        place, width = self.place, self.size
        owned = [[place[t] for t in terms_of(w) if t in place] for w in words.distinct]
        n = np.fromiter(map(len, owned), np.int64, len(owned))
        if not n.sum():
            return (np.zeros(0, np.int64),) * 3
        flat = np.fromiter((t for o in owned for t in o), np.int64, int(n.sum()))
        start = np.cumsum(n) - n
        times = n[words.word]
        at = np.repeat(start[words.word] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        key = np.repeat(words.row, times) * width + flat[at]
        order, back = np.unique(key, return_inverse=True)
        count = np.bincount(back, weights=np.repeat(words.count, times)).astype(np.int64)
        return order // width, order % width, count


def sample(labels: DataFrame, label: str, per_class: int, sizes: dict[str, int]) -> DataFrame:
    """About `per_class` rows of each class (all, if it has fewer), chosen by hashed doc_id.

    `sizes` are the classes' row counts: a class keeps the ids below a share of the
    hash range, so the sample is bounded by the parameter, not by the data.
    """
    share = F.lit(0.0)
    for c, n in sizes.items():
        share = F.when(F.col(label) == c, F.lit(min(1.0, per_class / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labels.where(place < share)


def examples(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[
        DataFrame, dict[str, int]]:
    """Staged (doc_id, text, label) of a bounded sample, and the classes' full sizes.

    The sampled labels are few by construction, so they are broadcast and the texts
    of the corpus are not shuffled.
    """
    full = class_sizes(labels, label)
    chosen = F.broadcast(sample(labels, label, per_class, full))
    return stage(only(docs, "doc_id", "text").join(chosen, "doc_id"), "examples"), full


def document_counts(rows: DataFrame, label: str) -> DataFrame:
    """(term, class, n): texts of each class that hold a term."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit=SLICE_BYTES):
            words = Words(batch.column("text"))
            classes, cls = np.unique(batch.column(label).to_pylist(), return_inverse=True)
            owned = [terms_of(w) for w in words.distinct]
            names: dict[str, int] = {}
            flat = [names.setdefault(t, len(names)) for o in owned for t in o]
            n = np.fromiter(map(len, owned), np.int64, len(owned))
            start, times = np.cumsum(n) - n, n[words.word]
            at = np.repeat(start[words.word] - (np.cumsum(times) - times), times) \
                + np.arange(times.sum())
            pair = np.unique(np.repeat(words.row, times) * max(1, len(names))
                             + np.array(flat, np.int64)[at])
            row, term = np.divmod(pair, max(1, len(names)))
            key, count = np.unique(term * len(classes) + cls[row], return_counts=True)
            listed = pa.array(list(names), pa.string())
            yield pa.RecordBatch.from_arrays(
                [listed.take(pa.array(key // len(classes))),
                 pa.array(classes[key % len(classes)].astype(str)), pa.array(count, pa.int64())],
                ["term", "cls", "n"])
    return (only(rows, "text", label).mapInArrow(scan, "term string, cls string, n long")
            .groupBy("term", "cls").agg(F.sum("n").alias("n")))


def vocabulary(rows: DataFrame, label: str, sizes: dict[str, int], limit: int,
               least: int = 3, significance: float = 15.0, lift: float = 3.0) -> list[str]:
    """Up to `limit` terms most tied to the classes, by the G² of presence.

    A term must be `lift` times as frequent in some class as in another: topic and
    language words that lean a little would drown the telling ones. `rows` is a
    bounded sample with `sizes` rows of each class.
    """
    total = sum(sizes.values())
    known = document_counts(rows, label)
    wide = known.groupBy("term").pivot("cls", sorted(sizes)).agg(F.sum("n")).na.fill(0)
    present = sum((F.col(f"`{c}`") for c in sizes), F.lit(0))
    wide = wide.withColumn("_all", present).where(F.col("_all") >= least)

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    g2 = sum((part(F.col(f"`{c}`"), F.col("_all") * n / total)
              + part(n - F.col(f"`{c}`"), (total - F.col("_all")) * n / total)
              for c, n in sizes.items()), F.lit(0.0)) * 2
    rates = [(F.col(f"`{c}`") + 0.5) / (n + 1) for c, n in sizes.items()]
    tells = F.greatest(*rates) >= lift * F.least(*rates) if len(rates) > 1 else F.lit(True)
    best = (wide.where(tells).select("term", g2.alias("g2")).where(F.col("g2") >= significance)
            .orderBy(F.desc("g2"), "term").limit(limit))
    return [r["term"] for r in best.toLocalIterator()]


def class_sizes(rows: DataFrame, label: str) -> dict[str, int]:
    return {r[label]: r["n"] for r in rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("n")).toLocalIterator()}


__all__ = ["Counter", "Words", "class_sizes", "examples", "sample", "terms_of", "vocabulary"]
