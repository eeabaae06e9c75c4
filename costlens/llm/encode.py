"""Token ids of whole texts, each distinct word encoded once.

Texts are cut where the tokenizer's own word splitting always cuts: before an
ASCII space that is followed by a non-space character (byte-level splitting keeps
that space with the next word), or at spaces and newlines (a splitter that drops
white space), between a letter and a punctuation mark, and between a line's end and
a letter. The cuts are found in the bytes of all texts at once, before anything is
looked up: words are then told apart whatever marks follow them. The library encodes
every distinct piece, and a text's ids are those of its pieces in turn, so they
equal the ids of the whole text. Latin letters are one word to these splitters, so
they go straight to the library's model. A text with runs of white space, which a
byte-level splitter treats as a whole, is encoded whole.
"""

from __future__ import annotations

import codecs
import gc
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
CACHE_PIECES = 500_000
#: Pieces that begin with a space and that white space before them would not leave as they are.
SPACE = r"^ (?:[\s\v\x85\p{Z}\x1c-\x1f]|$)"
#: Bytes that are a Latin letter, or the first and the second one of one above ASCII.
ASCII_LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
HIGH_LEAD = 0xC3
HIGH_LETTER = np.array([0x80 <= c < 0xC0 and c not in (0x97, 0xB7) for c in range(256)])
#: Bytes of ASCII that is neither white space nor control: a line's end after them stands alone.
INK = np.array([0x21 <= c < 0x7F for c in range(256)])


def cut_rule(spec: dict) -> str:
    """`lead`, `drop` or `whole`: where this tokenizer's texts may be cut."""
    pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec.get("truncation") or spec.get("padding"):
        return "whole"
    if (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and normal is None):
        return "lead"
    parts = pre.get("pretokenizers") or [{}]
    if parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" \
            and parts[0].get("invert") and "\\s" in str(parts[0].get("pattern")):
        return "drop"
    return "whole"


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range in turn; all lie below 2³¹."""
    ends = np.cumsum(length)
    return np.repeat((start - (ends - length)).astype(np.int32), length) + np.arange(
        ends[-1] if len(ends) else 0, dtype=np.int32)


def strings(values: pa.Array) -> list[str | None]:
    """Python strings, made all at once: `to_pylist` wraps each value first."""
    return values.to_numpy(zero_copy_only=False).tolist()


def letters_in(data: np.ndarray) -> np.ndarray:
    """Which bytes of valid UTF-8 belong to Latin letters (A-Z, a-z, À-ÿ but × and ÷)."""
    found = ASCII_LETTER[data]
    lead = np.flatnonzero(data == HIGH_LEAD)
    lead = lead[HIGH_LETTER[data[lead + 1]]]
    found[lead] = found[lead + 1] = True
    return found


def tiles(data: np.ndarray, edges: np.ndarray, lines: bool) -> tuple[np.ndarray, ...]:
    """Where the pieces of texts begin in their bytes (their end last), which are words, and
    which belong to a part that begins with a space.

    `edges`: where texts begin, and the end. A part of a text begins with it, with a space
    or (`lines`) with a letter after a line's end. Its letters, with that space, are a word
    if nothing or ASCII follows; what follows, or else the whole part, is a piece too.
    """
    n = len(data)
    letter = letters_in(data)
    begins = data == 0x20
    first = edges[:-1]
    begins[first[first < n]] = True
    if lines:
        end = np.flatnonzero(data[:-1] == 0x0A)
        before = np.maximum(end - 1, 0)
        begins[end[letter[end + 1] & (INK[data[before]] | letter[before])] + 1] = True
    start = np.flatnonzero(begins)
    after = np.append(start[1:], n)
    spaced = data[start] == 0x20
    inner = start + spaced
    ends = np.append(np.flatnonzero(letter[:-1] > letter[1:]) + 1, n)
    stop = np.minimum(ends[np.searchsorted(ends[:-1], inner, "right")], after)
    word = (inner < after) & letter[np.minimum(inner, n - 1)]
    word &= (stop == after) | (data[np.minimum(stop, n - 1)] < 0x80)
    bounds = np.stack([start, np.where(word, stop, start)], axis=1).ravel()
    some = np.append(bounds[1:], n) > bounds
    return (np.append(bounds[some], n), np.stack([word, np.zeros_like(word)], axis=1).ravel()[some],
            np.repeat(spaced, 2)[some])


@contextmanager
def uncollected():
    """No search for cycles while millions of small lists without any are made."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Encoder:
    """A tokenizer and the pieces it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.rule = cut_rule(json.load(f))
        from tokenizers.pre_tokenizers import ByteLevel
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        spelt = ["\ufffe"] * 256
        for c in (*range(0x80), *range(0xC0, 0x100)):
            for byte, char in zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0]):
                spelt[byte] = char
        self.spelt = "".join(spelt)
        self._forget()

    def _forget(self) -> None:
        # pieces after a space, and those at the start of a text or line
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.flat, self.start, self.length = (np.zeros(0, np.uint32), np.zeros(0, np.int64),
                                              np.zeros(0, np.int64))

    def _keep(self, pieces: list[str]) -> None:
        """Forget all but the pieces at hand, most of which are frequent."""
        old, flat, start, length = self.known, self.flat, self.start, self.length
        self._forget()
        for known, rows in zip(self.known, old):
            kept = [p for p in pieces if p in rows]
            row = np.fromiter(map(rows.__getitem__, kept), np.int64, len(kept))
            ends, first = np.cumsum(length[row]), len(self.start)
            self.start = np.concatenate([self.start, len(self.flat) + ends - length[row]])
            self.length = np.concatenate([self.length, length[row]])
            self.flat = np.concatenate([self.flat, flat[ranges(start[row], length[row])]])
            known.update(zip(kept, range(first, first + len(kept))))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[list[int]]:
        if not words:
            return []
        text = "\n".join(words)
        if self.rule == "drop":
            text = text.replace(" ", "")
        spelt = codecs.charmap_decode(text.encode(), "strict", self.spelt)[0]
        return [[t.id for t in found] for found in map(self.tokenizer.model.tokenize,
                                                       spelt.split(self.spelt[0x0A]))]

    def _add(self, found: list[list[int]]) -> range:
        """New rows of the piece table."""
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        first = len(self.start)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.flat = np.concatenate([self.flat, flat])
        return range(first, first + len(found))

    def _learn(self, pieces: list[str], word: np.ndarray, known: dict[str, int]) -> np.ndarray:
        """Rows of the piece table, which new pieces are added to."""
        row = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(row < 0)
        new = [pieces[i] for i in missing.tolist()]
        words, marks = missing[word[missing]], missing[~word[missing]]
        plain = [pieces[i] for i in words.tolist()]
        if self.rule == "drop":
            plain = [w.lower() for w in plain]
            fresh = [w for w in dict.fromkeys(plain) if w not in known]
            known.update(zip(fresh, self._add(self._word_ids(fresh))))
            row[words] = np.fromiter(map(known.__getitem__, plain), np.int64, len(plain))
        else:
            row[words] = self._add(self._word_ids(plain))
        row[marks] = self._add(self._ids([pieces[i] for i in marks.tolist()]))
        known.update(zip(new, row[missing].tolist()))
        return row

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = self._ids(texts.to_pylist())
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        return np.fromiter(chain.from_iterable(parts), np.uint32, int(bounds[-1])), bounds

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text's begin (one more at the end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.rule == "whole" or not len(texts):
            return self._whole(texts)
        if self.rule == "drop":
            texts = pc.replace_substring(texts, "\n", " ")
        lead = self.rule == "lead"
        _, edges, data = texts.buffers()
        edges = np.frombuffer(edges, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = data.slice(edges[0], edges[-1] - edges[0]) if data else pa.py_buffer(b"")
        edges, flat = edges - edges[0], np.frombuffer(data, np.uint8)
        begin, is_word, spaced = tiles(flat, edges, lead)
        coded = pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin),
                                                 data).dictionary_encode()
        code, n = coded.indices.to_numpy(), len(coded.dictionary)
        word = np.zeros(n, bool)
        word[code[is_word]] = True
        if lead:
            odd = np.zeros(n, bool)
            odd[~word] = pc.match_substring_regex(coded.dictionary.filter(pa.array(~word)),
                                                  SPACE).to_numpy(zero_copy_only=False)
            if odd.any():
                text = np.searchsorted(edges, begin[:-1][odd[code]], "right") - 1
                odd = np.zeros(len(texts), bool)
                odd[text] = True
                return self._merge(texts, odd)
        pieces = np.array(strings(coded.dictionary), object)
        if sum(map(len, self.known)) > CACHE_PIECES:
            self._keep(pieces.tolist())
        row = np.zeros(n, np.int64)
        with uncollected():
            for part, known in zip((spaced, ~spaced), self.known):
                some = np.zeros(n, bool)
                some[code[part]] = True
                row[some] = self._learn(pieces[some].tolist(), word[some], known)
        row = row[code]
        lengths = self.length[row]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return (self.flat[ranges(self.start[row], lengths)],
                ends[np.searchsorted(begin, edges)])

    def _merge(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with runs of white space go to the library whole."""
        runs = np.concatenate([[0], np.flatnonzero(np.diff(odd)) + 1, [len(odd)]])
        parts = [(self._whole if odd[a] else self.encode)(texts.slice(a, b - a))
                 for a, b in zip(runs[:-1], runs[1:])]
        bounds, base = [np.zeros(1, np.int64)], 0
        for ids, edge in parts:
            bounds.append(edge[1:] + base)
            base += len(ids)
        return np.concatenate([ids for ids, _ in parts]), np.concatenate(bounds)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker process, whose later tasks need not learn its words again."""
    return Encoder(path)


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `limit` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        block = (np.cumsum(size, dtype=np.int64) - size) // limit
        edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [batch.num_rows]])
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(int(a), int(b - a))
