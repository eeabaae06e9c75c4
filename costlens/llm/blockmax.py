"""Exact cosine search over inverted lists with block maxima, for batches of queries.

Terms are features of a fixed-size hash, so counts of all terms of a corpus of any size
are arrays of one length and nothing holds the terms' texts.
"""

from __future__ import annotations

import io
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from costlens.llm.encode import strings
from costlens.llm.tokens import open_fs

#: Features are the leading bits of a term's hash.
BITS = 22
SIZE = 1 << BITS
#: Bytes of texts: ASCII letters in lower case, zero for ASCII that is no letter.
FOLD = np.array([c if c > 127 else ord(chr(c).lower()) * chr(c).isalpha() for c in range(256)],
                np.uint8)
#: Examples of a block, most lists kept as rows of a matrix, and the share of the examples
#: from which a list is such a row.
BLOCK, DENSE, LONG = 256, 512, 1 / 16
#: Examples of a group, whose largest sums of short lists give a first bound.
GROUP = 32
#: Postings of short lists looked at together, which a core's cache holds, and queries.
POSTINGS, QUERIES = 1 << 16, 128


def feature(term: str) -> int:
    return xxhash.xxh64_intdigest(term) >> (64 - BITS)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range in turn."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def hashed(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of lower-cased pieces without ASCII marks, one after the other, and how many
    each piece has: other characters may still part its letters."""
    if not len(distinct):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, edges, data = distinct.buffers()
    edges = np.frombuffer(edges, np.int64)[:len(distinct)]
    own = np.fromiter(map(xxhash.xxh64_intdigest, strings(distinct)), np.uint64, len(distinct))
    times = np.ones(len(distinct), np.int64)
    high = np.bitwise_or.reduceat(np.frombuffer(data, np.uint8), edges) > 127
    if high.any():
        plain = pc.utf8_lower(distinct.filter(pa.array(high)).cast(pa.large_string()))
        lists = pc.split_pattern(pc.replace_substring_regex(plain, r"\P{L}+", " "), " ")
        runs = np.array(strings(lists.flatten()), object)
        of, solid = np.repeat(np.flatnonzero(high), np.diff(lists.offsets.to_numpy())), runs != ""
        times = ~high + np.bincount(of[solid], minlength=len(distinct))
        first = np.cumsum(times) - times
        whole, own = own, np.zeros(times.sum(), np.uint64)
        own[first[~high]] = whole[~high]
        own[ragged(first[high], times[high])] = [*map(xxhash.xxh64_intdigest, runs[solid])]
    return (own >> (64 - BITS)).astype(np.int64), times


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) triples in row order: hashed lower-cased runs of letters.

    Texts are cut at ASCII marks in their bytes; pieces are then told apart, and what else
    a piece holds besides letters is looked for once.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, edges, data = texts.buffers()
    edges = np.frombuffer(edges, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = FOLD[np.frombuffer(data or b"", np.uint8)[edges[0]:edges[-1]]]
    edges = edges - edges[0]
    inner = data != 0
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    first = edges[:-1][edges[:-1] < len(data)]
    begins[first] = inner[first]
    start = np.flatnonzero(begins)
    row = np.searchsorted(edges, start, "right") - 1
    begins = np.append(np.flatnonzero(begins[inner]), np.count_nonzero(inner))
    coded = pa.Array.from_buffers(
        pa.large_binary(), len(start),
        [None, pa.py_buffer(begins), pa.py_buffer(data[inner])]).dictionary_encode()
    own, times = hashed(coded.dictionary)
    piece = coded.indices.to_numpy()
    if (times != 1).any():
        at, times = (np.cumsum(times) - times)[piece], times[piece]
        row, piece = np.repeat(row, times), ragged(at, times)
    key, count = np.unique(row << BITS | own[piece], return_counts=True)
    return key >> BITS, key & (SIZE - 1), count


def weights(row: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray,
            rows: int) -> np.ndarray:
    """Unit-length (1 + log tf) · idf weights of (row, term, count) triples."""
    w = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(row, weights=w * w, minlength=rows))
    return w / np.maximum(norm, 1e-300)[row]


class Index:
    """Lists of (example, weight) by feature.

    Short lists are read whole. A long one is a row of a matrix, cut into blocks of
    examples with the largest weight of each; a block's product is taken for those
    queries only whose bound there reaches their k-th cosine.
    """

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int):
        self.rows, self.blocks = rows, -(-rows // BLOCK)
        self.edges = np.searchsorted(row, np.arange(rows + 1))
        self.term, self.weight = term, weight
        order = np.lexsort((row, term))
        self.known, self.begin = np.unique(term[order], return_index=True)
        self.length = np.diff(np.append(self.begin, len(order)))
        self.example, self.held = row[order].astype(np.int32), weight[order]
        longest = np.argsort(-self.length, kind="stable")[:DENSE]
        longest = longest[self.length[longest] > LONG * rows]
        self.place = np.full(SIZE, -1, np.int32)
        self.place[self.known] = np.arange(len(self.known))
        self.line = np.full(len(self.known), -1)
        self.line[longest] = np.arange(len(longest))
        self.matrix = np.zeros((len(longest), self.blocks * BLOCK))
        post = ragged(self.begin[longest], self.length[longest])
        self.matrix[np.repeat(np.arange(len(longest)), self.length[longest]),
                    self.example[post]] = self.held[post]
        self.peak = self.matrix.reshape(len(longest), self.blocks, BLOCK).max(axis=2, initial=0)
        self.products = 0

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, k: int,
                skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k examples of largest cosine above zero (ties: smaller place).

        Queries are (row, term, weight) triples in row order; `skip` names an example that
        a query must not find. The result is exact: a bound is the largest sum of short
        lists in a block plus the products with the long lists' peaks there.
        """
        out = []
        if not self.rows or not len(self.known):
            return [(np.zeros(0, np.int64), np.zeros(0))] * rows
        at = self.place[term]
        held = np.flatnonzero(at >= 0)
        row, at, weight = row[held], at[held], weight[held]
        for a in range(0, rows, QUERIES):
            b = min(a + QUERIES, rows)
            lo, hi = np.searchsorted(row, [a, b])
            out += self._nearest(row[lo:hi] - a, at[lo:hi], weight[lo:hi], b - a, k,
                                 None if skip is None else skip[a:b])
        return out

    def _sums(self, row: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Cosines' parts from short lists, for as many queries at a time as fit a cache."""
        wide, times, begin = self.blocks * BLOCK, self.length[at], self.begin[at]
        edges = np.searchsorted(row, np.arange(n + 1))
        before = np.concatenate([[0], np.cumsum(times)])[edges]
        score, a = np.empty((n, wide)), 0
        while a < n:
            b = int(np.searchsorted(before, before[a] + POSTINGS, "right")) - 1
            b = min(max(b, a + 1), n)
            part = slice(edges[a], edges[b])
            post = ragged(begin[part], times[part])
            score[a:b] = np.bincount(
                np.repeat((row[part] - a) * wide, times[part]) + self.example[post],
                np.repeat(weight[part], times[part]) * self.held[post],
                (b - a) * wide).reshape(b - a, wide)
            a = b
        return score

    def _nearest(self, row, at, weight, n, k, skip):
        line, wide = self.line[at], self.blocks * BLOCK
        short, long = line < 0, line >= 0
        score = self._sums(row[short], at[short], weight[short], n)
        if skip is not None:
            score[np.arange(n), skip] = -np.inf
        query = np.zeros((n, len(self.matrix)))
        query[row[long], line[long]] = weight[long]
        group = score.reshape(n, wide // GROUP, GROUP).max(axis=2)
        bound = group.reshape(n, self.blocks, BLOCK // GROUP).max(axis=2) + query @ self.peak
        k = min(k, wide)
        # sums of short lists never exceed the cosine, so k groups that reach a value bound
        # the k-th cosine at once
        least = np.full(n, -1e-12)
        if k <= group.shape[1]:
            at_k = group.shape[1] - k
            least += np.maximum(np.partition(group, at_k, axis=1)[:, at_k], 0)
        best, seen = np.zeros((n, k)), np.zeros((n, self.blocks), bool)
        for block in np.argsort(-bound.mean(axis=0), kind="stable"):
            which = np.flatnonzero((bound[:, block] >= least) & (bound[:, block] > 0))
            if not len(which):
                continue
            part = slice(block * BLOCK, (block + 1) * BLOCK)
            full = score[which, part] + query[which] @ self.matrix[:, part]
            score[which, part], seen[which, block] = full, True
            self.products += len(which)
            both = np.concatenate([best[which], full], axis=1)
            best[which] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            least[which] = np.maximum(least[which], best[which].min(axis=1) - 1e-12)
        score[~np.repeat(seen, BLOCK, axis=1)] = 0
        floor = np.maximum(best.min(axis=1) - 1e-12, 0)
        i, found = np.nonzero((score >= floor[:, None]) & (score > 0))
        s = score[i, found]
        first = np.lexsort((found, -np.round(s, 12), i))
        edges, found, s = np.searchsorted(i, np.arange(n + 1)), found[first], s[first]
        return [(found[a:min(a + k, b)], s[a:min(a + k, b)]) for a, b in zip(edges[:-1], edges[1:])]


def save(uri: str, **arrays: np.ndarray) -> None:
    """Write arrays to one file of the shared folder."""
    held = io.BytesIO()
    np.savez(held, **arrays)
    store, path = open_fs(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as sink:
        sink.write(held.getbuffer())


def load(uri: str) -> dict[str, np.ndarray]:
    store, path = open_fs(uri)
    with store.open_input_stream(path) as source, np.load(io.BytesIO(source.read())) as held:
        return {name: held[name] for name in held.files}


@lru_cache(maxsize=1)
def opened(uri: str) -> tuple[dict[str, np.ndarray], Index | None]:
    """A saved index and its other arrays; a worker keeps the last one between its tasks."""
    held = load(uri)
    row = np.repeat(np.arange(len(held["label"])), np.diff(held["edges"]))
    index = Index(row, held["term"], held["weight"], len(held["label"])) if len(row) else None
    return held, index
