"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max index.

The index holds a bounded sample of labelled examples with all their terms. One task
writes it to the shared folder, workers read it from there, and scores of all documents
come from one pass over their texts. The driver sees class sizes, paths and one vote per
example. Terms tied to a class weigh more, and no term is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from costlens import session
from costlens.llm import blockmax, terms
from costlens.llm.blockmax import features, weights
from costlens.llm.encode import sliced
from costlens.llm.tables import only, prepare, stage

#: Bound of the fitted sample: examples of each class.
EXAMPLES = 4096
#: A term is tied to a class if it is in so many examples, so significant by G² and so many
#: times as frequent in one class as in another; its weight is multiplied by EXTRA.
LEAST, SIGNIFICANCE, LIFT, EXTRA = 3, 15.0, 3.0, 4.0


def vote(score: np.ndarray, label: np.ndarray) -> float:
    """Share of the positive class, each neighbour weighted by nearness."""
    near = 1 / (1.05 - np.minimum(score, 1))
    return float((near * label).sum() / near.sum())


def platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit with a small ridge."""
    z, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2),
                               z.T @ (w * (y - p)) - 1e-2 * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def counted(examples: DataFrame) -> DataFrame:
    """(doc_id, y, h, term, n): features of examples with their counts, and a text hash."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit=terms.SLICE_BYTES):
            row, term, count = features(batch.column("text"))
            at = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), batch.column("h"),
                 pa.ListArray.from_arrays(at, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(count, pa.int64()))],
                ["doc_id", "y", "h", "term", "n"])

    return (examples.select(F.col("doc_id").cast("string"), F.col("y").cast("int"), "text",
                            F.xxhash64("text").alias("h"))
            .mapInArrow(scan, "doc_id string, y int, h long, term array<int>, n array<long>"))


def tied(row: np.ndarray, term: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Features that are far more frequent in one of two classes of examples."""
    n = np.array([np.sum(label == c) for c in (0, 1)], float)
    if not n.all():
        return np.zeros(0, np.int64)
    seen = [np.bincount(term[label[row] == c], minlength=blockmax.SIZE) for c in (0, 1)]
    at = np.flatnonzero(seen[0] + seen[1] >= LEAST)
    held = np.stack([s[at] for s in seen], 1).astype(float)
    share = held.sum(axis=1, keepdims=True) / n.sum()

    def part(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1) / expected), 0)

    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (part(held, share * n) + part(n - held, (1 - share) * n)).sum(axis=1)
    rate = (held + 0.5) / (n + 1)
    return at[(g2 >= SIGNIFICANCE) & (rate.max(axis=1) >= LIFT * rate.min(axis=1))]


@dataclass
class Model:
    """Path of the index, calibration, and the score of texts that share no term with it."""

    path: str | None
    k: int
    slope: float = 0.0
    offset: float = 0.0
    empty: float = 0.0

    def probability(self, found: np.ndarray, cosine: np.ndarray, label: np.ndarray) -> float:
        if not len(found):
            return self.empty
        x = self.slope * vote(cosine, label[found]) + self.offset
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(at, n): texts of `docs` that hold each feature, and at -1 their number."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(blockmax.SIZE, np.int64), 0
        for batch in sliced(batches, limit=terms.SLICE_BYTES):
            at, held = np.unique(features(batch.column("text"))[1], return_counts=True)
            seen[at] += held
            n += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], n), pa.int64())],
            ["at", "n"])

    return (only(docs, "text").mapInArrow(scan, "at int, n long")
            .groupBy("at").agg(F.sum("n").alias("n")))


def written(rows: DataFrame, root: str, make) -> str:
    """Path of a file that one task makes of all `rows`, which are bounded by a constant."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{root}/{uuid.uuid4().hex}.npz"
        blockmax.save(path, **make(pa.Table.from_batches(batches)))
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    found = rows.repartition(1).mapInArrow(write, "path string").toArrow()
    return found["path"][0].as_py()


def inverse_frequencies(counts: pa.Table) -> dict[str, np.ndarray]:
    """ln((1 + N) / (1 + n)) + 1 by feature; one that no text holds counts as held by one."""
    at, n = counts["at"].to_numpy(), counts["n"].to_numpy()
    seen = np.ones(blockmax.SIZE)
    seen[at[at >= 0]] = n[at >= 0]
    return {"idf": (np.log((1 + n[at < 0].sum()) / (1 + seen)) + 1).astype(np.float32)}


def layout(row: np.ndarray, term: np.ndarray, rows: int, extra: np.ndarray, h: np.ndarray,
           ids: list[str]) -> np.ndarray:
    """Order of examples that brings like weights together, so that peaks are tight:
    by length on a log scale, then by tied and frequent features, text hash and id."""
    size = np.bincount(row, minlength=rows)
    often = np.bincount(term, minlength=blockmax.SIZE)
    first = np.lexsort((term, -often[term], ~np.isin(term, extra), row))
    edges = np.concatenate([[0], np.cumsum(size)])
    lead = [tuple(term[first[a:min(b, a + 8)]]) for a, b in zip(edges[:-1], edges[1:])]
    scale = np.log2(size + 1).astype(int)
    return np.array(sorted(range(rows), key=lambda i: (scale[i], lead[i], h[i], ids[i])), np.int64)


def build(examples: pa.Table, idf: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the index: ids, labels, and (edges, term, weight) in the examples' order."""
    label = examples["y"].to_numpy().astype(np.int64)
    ids = examples["doc_id"].to_pylist()
    lists = examples["term"].combine_chunks()
    row = np.repeat(np.arange(len(label)), lists.value_lengths().to_numpy())
    term = lists.flatten().to_numpy().astype(np.int64)
    count = examples["n"].combine_chunks().flatten().to_numpy()
    extra = tied(row, term, label)
    order = layout(row, term, len(label), extra, examples["h"].to_numpy(), ids)
    idf = idf.copy()
    idf[extra] *= EXTRA
    weight = weights(row, term, count, idf, len(label))
    place = np.empty(len(label), np.int64)
    place[order] = np.arange(len(label))
    at = np.lexsort((term, place[row]))
    edges = np.searchsorted(place[row][at], np.arange(len(label) + 1))
    return {"idf": idf, "ids": np.array([ids[i] for i in order], str), "label": label[order],
            "edges": edges, "term": term[at].astype(np.int32), "weight": weight[at]}


def votes_of_others(spark: SparkSession, path: str, rows: int, k: int) -> pa.Table:
    """(place, y, vote) of every example by its nearest others; null without any."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = blockmax.opened(path)
        for batch in batches:
            place = batch.column("id").to_numpy()
            size = held["edges"][place + 1] - held["edges"][place]
            post = blockmax.ragged(held["edges"][place], size)
            found = index.nearest(np.repeat(np.arange(len(place)), size), held["term"][post],
                                  held["weight"][post], len(place), k, place) if index else []
            out = [vote(c, held["label"][f]) if len(f) else None for f, c in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), pa.array(held["label"][place]),
                 pa.array(out if index else [None] * len(place), pa.float64())],
                ["place", "y", "vote"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.range(0, rows, 1, n).mapInArrow(scan, "place long, y long, vote double").toArrow()


def fit(docs: DataFrame, labelled: DataFrame, label: str, k: int = 15,
        examples: int = EXAMPLES) -> Model:
    """A model from about `examples` rows of each class of `labelled` (doc_id, label).

    All terms of the examples count, and those tied to a class weigh `EXTRA` times as
    much. Document frequencies of all terms come from all of `docs`; the classes' full
    sizes weight the calibration, which uses the votes of an example's nearest others.
    Repeated labels of a document: the largest counts. Rows without a document, an id or a
    label of 0 or 1 are no examples; without any, every score is 0.
    """
    spark = prepare(docs.sparkSession)
    labels = (labelled.where(F.col(label).isin(0, 1)).groupBy("doc_id")
              .agg(F.max(label).cast("int").cast("string").alias("y")))
    chosen, full = terms.examples(docs, labels, "y", examples)
    sizes = terms.class_sizes(chosen, "y")
    if not sizes:
        return Model(None, k)
    root = session.run_path(spark, "toxicity")
    frequencies = written(stage(document_frequencies(docs), "frequencies"), root,
                          inverse_frequencies)
    path = written(counted(chosen), root, lambda held: build(held, blockmax.load(frequencies)["idf"]))
    votes = votes_of_others(spark, path, sum(sizes.values()), k)
    y, x = votes["y"].to_numpy(), votes["vote"].to_numpy()
    own = np.array([full[str(c)] / sizes[str(c)] for c in y])
    seen = ~np.isnan(x)
    prior = (own * y).sum() / own.sum()
    slope, offset = platt(x[seen], y[seen], own[seen]) if seen.any() else (0.0, 0.0)
    empty = ((own * y)[~seen].sum() + prior) / (own[~seen].sum() + 1)
    return Model(path, k, slope, offset, float(empty))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, evidence, cosines) for every row of `docs`.

    Scores see the text alone; its norm counts all its terms. Null and empty texts, and
    texts without any term of an example, score the rate of such examples. Repeated rows
    score alike; extra columns are ignored; without labelled rows every score is 0.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, predicted int, evidence array<string>, " \
             "cosines array<double>"

    def judged(texts: pa.Array, known: dict) -> list[tuple]:
        held, index = blockmax.opened(model.path)
        row, term, count = features(texts)
        weight = weights(row, term, count, held["idf"], len(texts))
        at = np.searchsorted(row, np.arange(len(texts) + 1))
        keys = [blockmax.xxhash.xxh128_digest(term[a:b].tobytes() + weight[a:b].tobytes())
                for a, b in zip(at[:-1], at[1:])]
        new = list({key: i for i, key in enumerate(keys) if key not in known}.values())
        size = np.diff(at)[new]
        post = blockmax.ragged(at[:-1][new], size)
        found = index.nearest(np.repeat(np.arange(len(new)), size), term[post], weight[post],
                              len(new), model.k) if index and new else []
        if len(known) > 20_000:
            kept = {key: known[key] for key in keys if key in known}
            known.clear()
            known.update(kept)
        for i, (f, c) in zip(new, found):
            known[keys[i]] = (model.probability(f, c, held["label"]), held["ids"][f[:5]].tolist(),
                              c[:5].tolist())
        return [known.get(key, (model.empty, [], [])) for key in keys]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in sliced(batches, limit=terms.SLICE_BYTES):
            out = (judged(batch.column("text"), known) if model.path
                   else [(0.0, [], [])] * batch.num_rows)
            p = np.array([o[0] for o in out])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p, pa.float64()),
                 pa.array((p >= 0.5).astype(np.int32)),
                 pa.array([o[1] for o in out], pa.list_(pa.string())),
                 pa.array([o[2] for o in out], pa.list_(pa.float64()))],
                ["doc_id", "score", "predicted", "evidence", "cosines"])

    return only(docs, "doc_id", "text").mapInArrow(scan, schema)
