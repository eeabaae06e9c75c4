"""Token ids of documents in bit-packed binary files, in ascending id order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from costlens import session
from costlens.llm.bits import Reader, Writer, crc32, width
from costlens.llm.encode import encoder as shared_encoder, sliced
from costlens.llm.tables import only, prepare, spread

MANIFEST = "part int, path string, n_docs long, n_ids long"


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with one end id after each document, and the new bounds."""
    return (np.insert(ids, bounds[1:], end_id).astype(np.uint32),
            bounds + np.arange(len(bounds)))


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, root: str, tokenizer: str, vocabulary: int, end_id: int = 1,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts and write them to files below `root`; returns the manifest.

    Documents are dealt out by key range, so file after file they ascend by key
    (nulls first); repeated keys are ordered by a hash of their text. A null or
    empty text is its end id alone. Each task writes one file under a name of its
    own, and the manifest, committed by Spark, lists those of the attempts that
    counted. Other columns are ignored. No rows: no file and an empty manifest.
    """
    prepare(docs.sparkSession)
    docs = only(docs, key, text).withColumn("_tie", F.xxhash64(text))
    bits = width(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, sink, n = None, None, None, 0
        part = TaskContext.get().partitionId()
        files, folder = open_fs(root)
        path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.ids"
        for batch in sliced(batches, text):
            if writer is None:
                encoder = shared_encoder(tokenizer)
                files.create_dir(folder, recursive=True)
                sink = files.open_output_stream(path)
                writer = Writer(sink, bits)
            ids, bounds = with_end(*encoder.encode(batch.column(text)), end_id)
            writer.add(batch.column(key), ids, bounds[1:])
            n += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([path.rpartition("/")[2]]),
                 pa.array([n], pa.int64()), pa.array([writer.total], pa.int64())],
                ["part", "path", "n_docs", "n_ids"])

    spark = docs.sparkSession
    dealt = (docs.repartitionByRange(spread(docs, text), F.col(key).asc_nulls_first(), "_tie")
             .sortWithinPartitions(F.col(key).asc_nulls_first(), "_tie"))
    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def read_tokens(spark: SparkSession, root: str, key_type: str = "long",
                key: str = "doc_id") -> DataFrame:
    """Every document of the files: key, start (ids before it), n_tokens, ids (binary)."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    before = F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base"))
    schema = f"`{key}` {key_type}, start long, n_tokens long, ids binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_fs(root)
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{folder}/{path}") as source:
                    for keys, ids, at in Reader(source).documents(256):
                        parts = [ids[a:b].tobytes() for a, b in zip(at[:-1] - at[0], at[1:] - at[0])]
                        yield pa.RecordBatch.from_arrays(
                            [keys, pa.array(at[:-1] + base, pa.int64()),
                             pa.array(np.diff(at), pa.int64()), pa.array(parts, pa.binary())],
                            [key, "start", "n_tokens", "ids"])

    return files.repartition(max(1, manifest.count())).mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 1) -> DataFrame:
    """Write the files to a new folder and read them back."""
    spark = docs.sparkSession
    root = session.run_path(spark, "tokens")
    write_tokens(docs, root, tokenizer, vocabulary, end_id)
    return read_tokens(spark, root, docs.schema["doc_id"].dataType.simpleString())


__all__ = ["crc32", "read_tokens", "token_files", "with_end", "write_tokens"]
