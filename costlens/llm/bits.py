"""Fixed-width bit packing of ids in blocks, and a file of such blocks.

File: 32-byte header (magic, version, bits, ids per block, number of ids as u64,
8 spare bytes), the blocks, then an Arrow IPC footer with one row per document (its
id and the end of its ids) and the block offsets in the schema's metadata, then the
footer's length as u64. All numbers are little-endian. Every block but the last holds
the same number of ids, so id i lies in block i // BLOCK_IDS.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAGIC = b"IDBK"
HEADER = struct.Struct("<4sIIIQQ")
BLOCK_IDS = 1 << 15


def width(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """`bits` low bits of every id, first id in the lowest bits."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(rows[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little")
    rows = np.zeros((count, 32), np.uint8)
    rows[:, :bits] = flat.reshape(count, bits)
    return np.packbits(rows, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Appends documents to one file; memory holds a block and the footer."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits, self.rest = sink, bits, np.zeros(0, "<u4")
        self.keys, self.ends, self.offsets, self.total, self.at = [], [], [], 0, HEADER.size
        sink.write(HEADER.pack(MAGIC, 1, bits, BLOCK_IDS, 0, 0))

    def _blocks(self, last: bool) -> None:
        stop = len(self.rest) if last else len(self.rest) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, stop, BLOCK_IDS):
            data = pack(self.rest[i:min(i + BLOCK_IDS, stop)], self.bits)
            self.offsets.append(self.at)
            self.sink.write(data)
            self.at += len(data)
        self.rest = self.rest[stop:]

    def add(self, keys: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents in turn: their keys, all their ids, and where each one's end."""
        self.keys.append(keys)
        self.ends.append(self.total + ends)
        self.total += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype("<u4")])
        self._blocks(False)

    def close(self) -> None:
        self._blocks(True)
        meta = {b"ids": str(self.total).encode(),
                b"blocks": np.array(self.offsets, "<u8").tobytes().hex().encode()}
        footer = pa.table({"key": pa.chunked_array(self.keys),
                           "end": np.concatenate(self.ends).astype(np.int64)})
        out = pa.BufferOutputStream()
        with pa.ipc.new_file(out, footer.schema.with_metadata(meta)) as w:
            w.write_table(footer.replace_schema_metadata(meta))
        data = out.getvalue()
        self.sink.write(data)
        self.sink.write(struct.pack("<Q", data.size))


class Reader:
    """Random access to one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(0)
        magic, _, self.bits, self.block, _, _ = HEADER.unpack(source.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        source.seek(size - 8)
        length, = struct.unpack("<Q", source.read(8))
        source.seek(size - 8 - length)
        footer = pa.ipc.open_file(pa.py_buffer(source.read(length))).read_all()
        meta = footer.schema.metadata
        self.total = int(meta[b"ids"])
        self.offsets = np.frombuffer(bytes.fromhex(meta[b"blocks"].decode()), "<u8")
        self.keys, self.ends = footer.column("key"), footer.column("end").to_numpy()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop), read from the blocks that hold them alone."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        count = min((last + 1) * self.block, self.total) - first * self.block
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(-(-count * self.bits // 8))
        return unpack(data, count, self.bits)[start - first * self.block:stop - first * self.block]

    def documents(self, step: int = 1024) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Keys, ids and bounds of up to `step` documents at a time."""
        for i in range(0, len(self.ends), step):
            ends = self.ends[i:i + step]
            start = int(self.ends[i - 1]) if i else 0
            ids = self.ids(start, int(ends[-1]))
            yield self.keys.slice(i, step).combine_chunks(), ids, np.concatenate([[start], ends])


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
