"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

Two words that differ by one inserted, deleted or replaced letter agree before and after
one of SEGMENTS parts of the shorter one. So each word is listed under what is left of it
without each part in turn (as the shorter word of a pair and as the longer one), and only
words of one list are compared. A list of over LIMIT words has its part halved, and again,
down to parts of one letter, whose lists are bounded by the alphabet; nothing is dropped.

A list is sorted. It is scanned for each of its words with the banded rows of the edit
matrix: words with a common prefix (their LCP) share the rows of that prefix, a row of
which no cell is below two ends the scan of all words with that prefix, and the rows of
all scans of a chunk advance together, letter by letter.

Each pair is counted in one list only: that of the part which holds its last possible
place of the edit (counted from the end), so counts and best matches add up without the
pairs ever being written.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from costlens.llm.encode import sliced
from costlens.llm.tables import dealt, only, prepare, stage

LEAST, DIVISOR, FACTOR = 7, 31, 10
SEGMENTS, LIMIT = 4, 4096
#: Distinct words held before they are passed on, pairs of one list and scan, and bytes of
#: letters in a chunk: bounds on memory, not on what is compared.
HELD, SCANS, CHUNK = 200_000, 1 << 21, 4 << 20
NEAR = "word string, n_near long, best struct<less long, word string>"


def drop_letter(run: str, prefix_crc: int) -> str:
    """The run without the letter that the checksum of `<doc_id>:<run>` names, if any."""
    h = zlib.crc32(run.encode(), prefix_crc)
    if h % DIVISOR:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1:]


def words(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n): words of at least `least` letters after the deletions, counted over all
    texts. A null text has none; a null doc_id reads as an empty one."""
    prepare(docs.sparkSession)
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in sliced(batches):
            keys = batch.column("doc_id").to_pylist()
            for key, text in zip(keys, batch.column("text").cast(pa.large_binary()).to_pylist()):
                if text is None:
                    continue
                prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
                for run, n in Counter(runs.findall(text.lower().decode("utf-8", "replace"))).items():
                    word = drop_letter(run, prefix)
                    if len(word) >= least:
                        found[word] += n
            if len(found) > HELD:
                yield _counted(found)
                found = Counter()
        yield _counted(found)

    counted = only(docs, "doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()),
                                       pa.array(list(found.values()), pa.int64())], ["word", "n"])


def _listed(words: DataFrame, parts: Column) -> DataFrame:
    """Rows (key, short, s, e, word, n): words under their rest without letters s..e of a
    shorter word of `short` letters. `parts` gives an array of (short, s, e)."""
    rows = words.select("word", "n", F.explode(parts).alias("p")).select("word", "n", "p.*")
    return rows.select(
        F.xxhash64("short", "s", "e", F.expr("substring(word, 1, s)"),
                   F.expr("right(word, short - e)")).alias("key"), "short", "s", "e", "word", "n")


def _first_parts() -> Column:
    length = F.length("word")

    def of(short: Column) -> Column:
        def edge(i):
            return F.floor(i * short / SEGMENTS).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda i: F.struct(
            short.alias("short"), edge(i).alias("s"), edge(i + 1).alias("e")))

    return F.when(length > LEAST, F.concat(of(length), of(length - 1))).otherwise(of(length))


def _halves() -> Column:
    middle = F.floor((F.col("s") + F.col("e")) / 2).cast("int")
    return F.array(F.struct("short", "s", middle.alias("e")),
                   F.struct("short", middle.alias("s"), "e"))


def lists(vocabulary: DataFrame, limit: int = LIMIT) -> list[DataFrame]:
    """Tables of `_listed` rows whose lists hold at most `limit` words each, or whose part
    is one letter."""
    rows, done = _listed(dealt(vocabulary, "word"), _first_parts()), []
    while True:
        large = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("e") - F.col("s"))
                                         .alias("width"))
                 .where((F.col("c") > limit) & (F.col("width") > 1)).select("key"))
        large = stage(large, "long-lists")
        if large.isEmpty():
            return [*done, rows]
        done.append(rows.join(large, "key", "left_anti"))
        rows = stage(_listed(rows.join(large, "key", "left_semi"), _halves()), "split-lists")


def matrix(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of words (Latin-1, one byte each; zero behind the end) and their lengths."""
    texts = [w.encode("latin-1") for w in words.to_pylist()]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    wide = int(lengths.max(initial=0)) + 2
    letters = np.frombuffer(b"".join(t.ljust(wide, b"\0") for t in texts), np.uint8)
    return letters.reshape(len(texts), wide), lengths


def prefixes(letters: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Letters that each row shares with the one above; -1 for the first row of a list."""
    lcp = np.zeros(len(letters), np.int64)
    lcp[1:] = np.logical_and.accumulate(letters[1:] == letters[:-1], axis=1).sum(axis=1)
    lcp[first == np.arange(len(letters))] = -1
    return lcp


def scan(letters: np.ndarray, lengths: np.ndarray, lcp: np.ndarray, first: np.ndarray,
         last: np.ndarray, shared: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): of `rows` those a and of their lists those b that are one edit apart.

    Lists are sorted and distinct; row i's is first[i]..last[i], and its rows are taken to
    share `shared[i]` letters.
    """
    n, wide = letters.shape
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = rows[np.argsort(shared[rows], kind="stable")]
    starts = shared[waiting]
    q = lo = hi = np.zeros(0, np.int64)
    row = np.zeros((3, 0), np.uint8)
    for depth in range(int(starts.min(initial=wide)), wide):
        new = waiting[np.searchsorted(starts, depth):np.searchsorted(starts, depth, "right")]
        if len(new):
            # after `depth` equal letters: one deleted, none, one inserted
            begin = np.broadcast_to(np.array([[1 if depth else 2], [0], [1]], np.uint8), (3, len(new)))
            q, lo, hi = (np.concatenate(x) for x in ((q, new), (lo, first[new]), (hi, last[new])))
            row = np.concatenate([row, begin], axis=1)
        if not len(q):
            if depth >= starts[-1]:
                break
            continue
        # children: ranges of rows that share one more letter
        edges = np.append(np.flatnonzero(lcp <= depth), n)
        a, b = np.searchsorted(edges, lo), np.searchsorted(edges, hi)
        count = b - a
        parent = np.repeat(np.arange(len(q)), count)
        child = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count) + a[parent]
        q, lo, hi, row = q[parent], edges[child], edges[child + 1], row[:, parent]
        x = letters[lo, depth]
        ended = x == 0
        if ended.any():
            gap = lengths[q] - depth + 1
            hit = ended & (gap >= 0) & (gap <= 2)
            hit[hit] = row[gap[hit], np.flatnonzero(hit)] == 1
            found.append((q[hit], lo[hit]))
            q, lo, hi, row, x = q[~ended], lo[~ended], hi[~ended], row[:, ~ended], x[~ended]
        before = letters[q, depth - 1] if depth else np.zeros(len(q), np.uint8)
        c0 = np.minimum(row[0] + ((x != before) | (depth == 0)), row[1] + 1)
        c1 = np.minimum(np.minimum(row[1] + (x != letters[q, np.minimum(depth, wide - 1)]),
                                   row[2] + 1), c0 + 1)
        c2 = np.minimum(row[2] + (x != letters[q, np.minimum(depth + 1, wide - 1)]), c1 + 1)
        row = np.minimum(np.stack([c0, c1, c2]), 2).astype(np.uint8)
        alive = row.min(axis=0) < 2
        q, lo, hi, row = q[alive], lo[alive], hi[alive], row[:, alive]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def common(letters: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray,
           ends: bool) -> np.ndarray:
    """Letters that rows a and b have in common at their beginnings or ends."""
    out, going = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(letters.shape[1]):
        x, y = a[going], b[going]
        fits = k < np.minimum(lengths[x], lengths[y])
        i, j = (lengths[x] - 1 - k, lengths[y] - 1 - k) if ends else (k, k)
        going = going[fits & (letters[x, i] == letters[y, j])]
        if not len(going):
            break
        out[going] = k + 1
    return out


def matches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near-word counts and best near words over whole lists, sorted by key and word."""
    key = table.column("key").to_numpy()
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(edge, len(key)))
    keep = np.repeat(size > 1, size)
    if not keep.any():
        return
    table, size = table.filter(pa.array(keep)), size[size > 1]
    ends = np.cumsum(size)
    # a chunk of lists: its letters are bounded, by its longest word so far
    longest = np.maximum.accumulate(table.column("short").to_numpy()[ends - 1].astype(np.int64))
    cost = np.cumsum(size * (longest + 3)) // CHUNK
    cuts = np.append(np.flatnonzero(np.diff(cost)) + 1, len(size))
    at = done = 0
    for cut in cuts:
        part = table.slice(at, int(ends[cut - 1]) - at).combine_chunks()
        own = size[done:cut]
        at, done = int(ends[cut - 1]), int(cut)
        yield from _matched(part, own)


def _matched(part: pa.Table, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    column = part.column("word").combine_chunks()
    letters, lengths = matrix(column)
    n, short, s, e = (part.column(c).to_numpy().astype(np.int64) for c in ("n", "short", "s", "e"))
    last = np.repeat(np.cumsum(size), size)
    first = last - np.repeat(size, size)
    lcp = prefixes(letters, first)
    block = np.cumsum(last - first) // SCANS
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
    a, b = (np.concatenate(x) for x in zip(*(
        scan(letters, lengths, lcp, first, last, s, np.arange(i, j))
        for i, j in zip(cuts[:-1], cuts[1:]))))
    # exact check, which also settles lists whose keys happen to collide
    before, after = (common(letters, lengths, a, b, ends) for ends in (False, True))
    less, more = np.minimum(lengths[a], lengths[b]), np.maximum(lengths[a], lengths[b])
    near = (more - less < 2) & (before + after >= less - (less == more))
    listed = (less == short[a]) & (short[a] == short[b]) & (s[a] == s[b]) & (e[a] == e[b])
    place = short[a] - after
    own = ((place > s[a]) | ((place == 0) & (s[a] == 0))) & (place <= e[a])
    good = near & listed & own
    a, b = a[good], b[good]
    if not len(a):
        return
    order = np.lexsort((b, -n[b], a))
    a, b = a[order], b[order]
    head = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    best = pa.StructArray.from_arrays([pa.array(-n[b[head]]), column.take(pa.array(b[head]))],
                                      ["less", "word"])
    yield pa.RecordBatch.from_arrays(
        [column.take(pa.array(a[head])), pa.array(np.diff(np.append(head, len(a)))), best],
        ["word", "n_near", "best"])


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, cut only between lists: a batch's last list waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        if held and held[-1].column("key")[0].as_py() == key[-1]:
            held.append(batch)
            continue
        cut = int(np.searchsorted(key, key[-1]))
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def near(vocabulary: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, best): how many words of the (word, n) table are one edit away, and
    of them the one of largest n (`best.less` is -n; ties: smallest word). Words without
    any are left out. Words are of the letters a-z and À-ÿ."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_lists(batches):
            yield from matches(table)

    parts = None
    for rows in lists(vocabulary, limit):
        got = rows.repartition("key").sortWithinPartitions("key", "word").mapInArrow(find, NEAR)
        parts = got if parts is None else parts.unionByName(got)
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word that forms lead to.

    Only words with a form have rows. Counts grow along forms, so there is no cycle, and
    paths halve each round.
    """
    state = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        state = stage(state.join(ahead, "root", "left"), "roots")
        if state.where("further IS NOT NULL").isEmpty():
            return state.select("word", "root")
        state = state.select("word", F.coalesce("further", "root").alias("root"))


def variants(docs: DataFrame, least: int = LEAST, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word that occurs at least twice.

    `words` says what a word is. Its form is its near word of largest n (ties: the
    smallest), if that n is at least `factor` times its own; else form and form_n are
    null. The root is where forms end, the word itself without one. Repeated rows count
    each time, other columns are ignored, no rows give none.
    """
    vocabulary = stage(words(docs, least).where("n >= 2"), "vocabulary")
    found = vocabulary.join(near(vocabulary), "word", "left")
    most = -F.col("best.less")
    has = most >= factor * F.col("n")
    found = stage(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                               F.when(has, F.col("best.word")).alias("form"),
                               F.when(has, most).alias("form_n")), "forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
