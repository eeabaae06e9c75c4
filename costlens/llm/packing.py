"""Packing along a space-filling curve.

A document's hashed token vector is projected to a few dimensions; its Hilbert
index there orders the corpus, so that neighbours on the curve are alike. The
ordered ids are one stream, cut at every multiple of the sequence length: only the
last sequence can have padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from costlens.llm.encode import encoder as shared_encoder, sliced
from costlens.llm.tables import only, prepare, spread, stage
from costlens.llm.tokens import with_end

DIMS, BITS = 4, 8
HALVES = np.array([1, 1 << 32])


def projection(n: int, dims: int = DIMS) -> np.ndarray:
    """Signs of `n` hashed coordinates in each dimension (a mixed counter's top bits)."""
    z = np.arange(1, n * dims + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    return ((z >> np.uint64(40) & np.uint64(1)).astype(np.float32) * 2 - 1).reshape(n, dims)


def grid(ids: np.ndarray, bounds: np.ndarray, signs: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Cell of each document: the mean projection of its ids, spread by a square root."""
    count = np.diff(bounds)
    out = np.zeros((len(count), signs.shape[1]), np.float64)
    some = count > 0
    if some.any():
        row = ids % len(signs)
        for d in range(0, signs.shape[1], 2):
            # plus signs of two dimensions are counted in the halves of one number
            pair = (signs[:, d:d + 2] > 0).astype(np.int64)
            both = np.add.reduceat((pair @ HALVES[:pair.shape[1]])[row], bounds[:-1][some])
            plus = np.stack([both & 0xFFFFFFFF, both >> 32], axis=1)[:, :pair.shape[1]]
            out[some, d:d + 2] = (2 * plus - count[some, None]) / count[some, None]
    unit = (np.sign(out) * np.sqrt(np.abs(out)) + 1) / 2
    return np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer cells: undo the curve's rotations from the top bit down."""
    x = cells.T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            high = (x[d] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, 0) ^ swap
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | x[d] >> level & 1
    return key


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each range of a flat array, which is not copied."""
    edges = (bounds * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1,
                                 [None, pa.py_buffer(edges), pa.py_buffer(data)])


def flat(values: pa.Array, kind: str) -> np.ndarray:
    """The numbers of all binary values in turn."""
    _, edges, data = values.buffers()
    edges = np.frombuffer(edges, np.int32)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(data.slice(edges[0], edges[-1] - edges[0]), kind)


def encoded(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 1) -> DataFrame:
    """(rid, doc_id, key, n, ids): staged rows with a curve key and narrow binary ids."""
    narrow = "<u2" if vocabulary <= 1 << 16 else "<u4"
    # few large tasks: each meets most words once, and encodes a word once
    rows = only(docs, "doc_id", "text").coalesce(spread(docs)).withColumn(
        "rid", F.monotonically_increasing_id())
    schema = f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, " \
             "key long, n long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = signs = None
        for batch in sliced(batches):
            if encoder is None:
                encoder, signs = shared_encoder(tokenizer), projection(1 << 16)
            ids, bounds = encoder.encode(batch.column("text"))
            key = hilbert(grid(ids, bounds, signs))
            ids, bounds = with_end(ids, bounds, end_id)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), pa.array(key, pa.int64()),
                 pa.array(np.diff(bounds), pa.int64()), binaries(ids.astype(narrow), bounds)],
                ["rid", "doc_id", "key", "n", "ids"])

    return stage(rows.mapInArrow(encode, schema), "encoded")


def positions(rows: DataFrame) -> DataFrame:
    """(rid, pos): ids before each row in (key, doc_id, rid) order.

    Only the three sort columns and the length move. Partitions are ranges of the
    order; each adds up its own rows, and one total per partition joins them.
    """
    order = ["key", "doc_id", "rid"]
    dealt = rows.select(*order, "n").repartitionByRange(*order).sortWithinPartitions(*order)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("rid"), pa.array(ends - n, pa.int64()),
                 batch.column("n")], ["part", "rid", "local", "n"])
            before = int(ends[-1]) if len(ends) else before

    local = stage(dealt.select(F.spark_partition_id().alias("part"), "rid", "n").mapInArrow(
        add_up, "part int, rid long, local long, n long"), "curve-order")
    totals = local.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return local.join(bases, "part").select("rid", (F.col("base") + F.col("local")).alias("pos"))


def pack(docs: DataFrame, tokenizer: str, vocabulary: int, length: int = 2048,
         end_id: int = 1) -> DataFrame:
    """Pieces of whole documents in sequences of `length` ids.

    Columns: doc_id, start (ids of the document before the piece), length, ids
    (binary, little-endian u32), doc_tokens, sequence_id, offset. Null and empty
    texts are one piece with the end id. Repeated rows are documents of their own;
    equal keys are ordered by doc_id. Extra columns are ignored; no rows, no pieces.
    """
    prepare(docs.sparkSession)
    rows = encoded(docs, tokenizer, vocabulary, end_id)
    narrow = "<u2" if vocabulary <= 1 << 16 else "<u4"
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, " \
             "sequence_id long, `offset` long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, n = batch.column("pos").to_numpy(), batch.column("n").to_numpy()
            if not len(n):
                continue
            first = pos // length
            pieces = (pos + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] + nth
            begin = np.maximum(pos[row], sequence * length)
            end = np.minimum((pos + n)[row], (sequence + 1) * length)
            start = begin - pos[row]
            # a document's pieces follow each other, as its ids do
            data = binaries(flat(batch.column("ids"), narrow).astype("<u4"),
                            np.concatenate([[0], np.cumsum(end - begin)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in
                                                               (start, end - begin)),
                 data, *(pa.array(x, pa.int64()) for x in
                                                (n[row], sequence, begin - sequence * length))],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    placed = rows.join(positions(rows), "rid").select("doc_id", "n", "pos", "ids")
    return placed.mapInArrow(cut, schema)
