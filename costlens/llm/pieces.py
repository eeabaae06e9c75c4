"""Token ids of a SentencePiece BPE model, exactly, by backtracking, and texts of ids.

The model merges, of all neighbours that form a piece, those of the best score first (of
equal ones the leftmost). A piece therefore has one way to be made, its split, and what
the merges make of a text is the only sequence of pieces of which every two neighbours
would stay apart if merged on their own. It is found from left to right:

* an Aho-Corasick automaton gives the longest piece at each place, and a table for each
  piece the next shorter one that it begins with;
* two neighbours are compatible if undoing their merges, the latest first, never comes to
  a pair at the seam that would have been merged earlier than what was undone;
* where nothing fits, the place is marked in a bit field and the last piece is shortened:
  as the ids of a prefix are unique, a failed place need never be tried again.

Texts are first cut where no piece lies across, so neither merges nor checks do: before
spaces and newlines, and in a word between letters that are neighbours in no piece.
Each distinct word is encoded once per worker.

Runs of the space mark are pieces of one equal, lowest score in some models, so they are
merged after all else, from the left; `Model` checks that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from costlens.llm.encode import sliced
from costlens.llm.tables import only, prepare

MARK = "▁"
#: Words, fragments and pairs remembered by a worker before it starts anew.
REMEMBERED = 600_000
NEVER = 1 << 62


class Model:
    """Pieces, merge splits and the automaton of one model file.

    For BPE models that fall back on bytes, put a space mark in front of a text and change
    nothing but spaces; others raise ValueError.
    """

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        probe = " a  b\t　ﬁ Å\n"
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model changes texts in other ways than marking spaces")
        n = sp.get_piece_size()
        self.end = sp.eos_id()
        kinds = [("byte" if sp.is_byte(i) else "control" if sp.is_control(i) else
                  "unknown" if sp.is_unknown(i) else "unused" if sp.is_unused(i) else "piece")
                 for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = [names.index(f"<0x{b:02X}>") for b in range(256)] if "byte" in kinds else []
        if not self.bytes or "unused" in kinds:
            raise ValueError("the model has no byte pieces, or unused ones")
        self.texts = [bytes([int(name[3:5], 16)]) if kind == "byte" else b"" if kind == "control"
                      else " ⁇ ".encode() if kind == "unknown" else
                      name.replace(MARK, " ").encode() for name, kind in zip(names, kinds)]
        self.id_of = {name: i for i, (name, kind) in enumerate(zip(names, kinds)) if kind == "piece"}
        self.leading = {i for name, i in self.id_of.items() if name[0] == MARK}
        self._rank({name: sp.get_score(i) for name, i in self.id_of.items()})
        self.size = {i: len(name) for name, i in self.id_of.items()}
        # letters that are no piece of their own still take part in merges
        for c in {c for name in self.ranks for c in name} - set(self.id_of):
            self.id_of[c] = -1 - ord(c)
            self.size[self.id_of[c]] = 1
        self._split()
        self.inside = {name[i:i + 2] for name in self.ranks for i in range(len(name) - 1)}
        if {pair[1] for pair in self.inside} & {MARK, "\n"}:
            raise ValueError("pieces that hold a space mark or a newline behind another letter")
        self.automaton, self.shorter = ahocorasick.Automaton(), {}
        known = {name: i for name, i in self.id_of.items() if len(name) == 1 or name in self.ranks}
        for name, i in known.items():
            self.automaton.add_word(name, i)
            begins = (known.get(name[:k]) for k in range(len(name) - 1, 0, -1))
            self.shorter[i] = next((x for x in begins if x is not None), None)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def _rank(self, scores: dict[str, float]) -> None:
        """Places of merged pieces in the order of merging; tied ones are kept aside."""
        merged = {name: s for name, s in scores.items() if len(name) > 1}
        lowest = min(merged.values(), default=0.0)
        self.tied = {name: self.id_of[name] for name, s in merged.items() if s == lowest}
        if len(self.tied) == 1:
            self.tied = {}
        rest = {name: s for name, s in merged.items() if name not in self.tied}
        if len(set(rest.values())) < len(rest) or any(set(name) != {MARK} for name in self.tied) \
                or (self.tied and any(MARK * 2 in name for name in rest)):
            raise ValueError("pieces of equal scores that are no runs of the space mark")
        self.ranks = {name: r for r, name in enumerate(sorted(rest, key=lambda x: -rest[x]))}

    def _split(self) -> None:
        """How each piece is made; pieces that merging never makes are dropped."""
        self.rank_of: dict[int, int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for name, rank in list(self.ranks.items()):
            parts = self.merge(name, rank)
            if len(parts) == 2:
                i, made = self.id_of[name], (self.id_of[parts[0]], self.id_of[parts[1]])
                self.rank_of[i], self.split[i], self.joined[made] = rank, made, i
            else:
                del self.ranks[name]

    def merge(self, text: str, below: int = NEVER) -> list[str]:
        """Plain merging with the pieces of a rank less than `below`."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best >= below:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Would merging the texts of a and b leave these two pieces?"""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        x, y, before = a, b, NEVER
        while True:
            made = self.joined.get((x, y))
            if made is not None and self.rank_of[made] < before:
                fits = False
                break
            late_x, late_y = self.rank_of.get(x, -1), self.rank_of.get(y, -1)
            if late_x < 0 and late_y < 0:
                fits = True
                break
            if late_x > late_y:  # of equal merges the left one comes first
                x, before = self.split[x][1], late_x
            else:
                y, before = self.split[y][0], late_y + 1
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[a, b] = fits
        return fits

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text in which every letter is in some piece (negative: bare letters)."""
        compatible, size, shorter = self.compatible, self.size, self.shorter
        end, at = len(text), 0
        failed = bytearray(end // 8 + 1)
        ids: list[int] = []
        longest = self.automaton.iter_long(text)
        i = next(longest)[1]
        while True:
            while i is not None:
                to = at + size[i]
                if not failed[to >> 3] >> (to & 7) & 1 and (not ids or compatible(ids[-1], i)):
                    break
                i = shorter[i]
                longest = None
            if i is not None:
                ids.append(i)
                at = to
                if at == end:
                    return ids
                longest = longest or self.automaton.iter_long(text, at)
                i = next(longest)[1]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                i = ids.pop()
                at -= size[i]
                i, longest = shorter[i], None

    def fragment(self, text: str) -> list[int]:
        """Ids of a fragment, a bare letter as its bytes."""
        if text in self.ranks:
            return [self.id_of[text]]
        if len(text) == 1:
            found = [self.id_of.get(text, -1)]
        else:
            found = self.backtrack(text)
        if min(found) >= 0:
            return found
        out, at = [], 0
        for i in found:
            length = self.size.get(i, 1)
            out += [i] if i >= 0 else [self.bytes[b] for b in text[at:at + length].encode()]
            at += length
        return out

    def fragments(self, word: str) -> list[str]:
        """The word cut between letters that are neighbours in no piece."""
        inside = self.inside
        cuts = [i for i, pair in enumerate(map(str.__add__, word, word[1:]), 1) if pair not in inside]
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    @lru_cache(maxsize=1024)  # noqa: B019 - one model per worker and file
    def run(self, length: int) -> list[int]:
        """Ids of so many space marks that nothing else takes: leftmost merges first."""
        parts, after = [1] * length, list(range(1, length + 1))
        before = list(range(-1, length - 1))
        waiting = [(i, 1, 1) for i in range(length - 1)] if MARK * 2 in self.tied else []
        heapify(waiting)
        while waiting:
            i, left, right = heappop(waiting)
            j = after[i]
            if parts[i] != left or j >= length or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = left + right, 0, after[j]
            if after[i] < length:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < length and MARK * (parts[x] + parts[after[x]]) in self.tied:
                    heappush(waiting, (x, parts[x], parts[after[x]]))
        return [self.tied.get(MARK * p, self.id_of.get(MARK, -1)) for p in parts if p]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space mark in front."""
        text = b"".join(map(self.texts.__getitem__, ids))
        if next((i for i in ids if self.texts[i]), None) in self.leading:
            text = text[1:]
        try:
            return text.decode()
        except UnicodeDecodeError:
            return repaired(text)


def repaired(data: bytes) -> str:
    """UTF-8 with a replacement character for each byte that belongs to none."""
    out, at = [], 0
    while at < len(data):
        lead = data[at]
        length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            out.append(data[at:at + length].decode())
            at += length
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


class Encoder:
    """A worker's model and the words it has met: rows of one flat table of ids."""

    def __init__(self, path: str):
        self.model = Model(path)
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.piece: dict[str, tuple[int, ...]] = {}
        self.flat, self.start, self.length = (np.zeros(0, np.int32), np.zeros(0, np.int64),
                                              np.zeros(0, np.int64))

    def _word(self, word: str) -> list[int]:
        out: list[int] = []
        for part in self.model.fragments(word):
            ids = self.piece.get(part)
            if ids is None:
                ids = self.piece[part] = tuple(self.model.fragment(part))
            out += ids
        return out

    def _learn(self, words: list[str]) -> None:
        found = [self._word(w) for w in words]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))
        first = len(self.start)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.flat = np.concatenate([self.flat, flat])
        self.row.update(zip(words, range(first, first + len(words))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, an end id after each, and where each text's begin (one
        more at the end)."""
        if max(len(self.row), len(self.piece)) > REMEMBERED:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # a word begins at each space, which is its mark, or newline, which gets a space
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        counts = pc.list_value_length(lists).to_numpy()
        coded = lists.flatten().dictionary_encode()
        words = [w if w[:1] == "\n" else MARK + w for w in coded.dictionary.to_pylist()]
        new = [w for w in words if w not in self.row]
        if new:
            self._learn(new)
        rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        rows = rows[coded.indices.to_numpy()]
        # an empty text has no word, though splitting gives it one
        some = pc.binary_length(texts).to_numpy() > 0
        rows = rows[np.repeat(some, counts)]
        edges = np.concatenate([[0], np.cumsum(counts * some)])
        lengths = self.length[rows]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.start[rows] - ends[:-1], lengths) + np.arange(ends[-1])
        bounds = ends[edges]
        ids = np.insert(self.flat[at], bounds[1:], self.model.end)
        return self._runs(ids, bounds + np.arange(len(bounds)))

    def _runs(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring space marks merged, after everything else."""
        alone = ids == self.model.id_of.get(MARK, -1)
        edge = np.diff(np.concatenate([[0], alone.astype(np.int8), [0]]))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = stops - starts > 1
        starts, stops = starts[long], stops[long]
        if not self.model.tied or not len(starts):
            return ids, bounds
        runs = [self.model.run(int(n)) for n in stops - starts]
        keep = np.ones(len(ids), bool)
        out = ids.copy()
        for a, b, run in zip(starts, stops, runs):
            out[a:a + len(run)] = run
            keep[a + len(run):b] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        return out[keep], kept[bounds]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process, which serves many tasks."""
    return Encoder(path)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string): the ids of every whole text and an end id,
    and the text that these ids decode to.

    A null or empty text is its end id alone and decodes to an empty one. Repeated rows
    stay, other columns are ignored, no rows give none. `model` is a path that executors
    can read.
    """
    prepare(docs.sparkSession)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>, decoded string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in sliced(batches, text):
            ids, bounds = e.encode(batch.column(text))
            decoded = [e.model.decode(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists, pa.array(decoded, pa.string())],
                                             [key, "ids", "decoded"])

    return only(docs, key, text).mapInArrow(scan, schema)
