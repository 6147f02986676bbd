"""Byte-level BPE in numpy: all different pieces of a batch are merged together in padded matrices.

A text is cut by the vocabulary's pattern.  Pieces not met before by this worker are encoded in
bulk: a piece that is a token as a whole is done; the others are grouped by length, one row of token
ids per piece, and in each round every row merges its leftmost pair of least rank.  Ranks of pairs
come from an open-addressing hash table; finished rows leave the matrix and columns close up.
Pieces above ``LONG`` bytes go row by row, merging all pairs of the least rank in one round as far as
that equals merging them one by one.

What a worker remembers is bounded in bytes, long pieces are not remembered, and long texts are worked through in windows.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; rows that repeat are
encoded alike, ties do not occur beyond equal ranks at several places (leftmost first); an empty table gives no rows;
an id that the vocabulary lacks raises an error.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from demandgauge.llm import words as W

NO_RANK = np.iinfo(np.int32).max
LONG = 256
#: Fixed value: the pattern of the public byte-level vocabularies.
WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pieces that a worker remembers (about; only a memory of results), new pieces encoded at once, characters cut at once.
MEMORY, FLUSH, WINDOW = 3 << 25, 1 << 16, 1 << 20
#: Cells of a matrix of pieces: about 100 bytes a cell are in use while they are merged.
CELLS = 1 << 17
_CUT = regex.compile(r"(?<=[^\s\x1c-\x1f\x85\u180e])(?= [\s\S])")


_LETTER, _NUMBER, _SPACE = 1, 2, 3


@functools.cache
def _kinds() -> np.ndarray:
    """For every character whether it is a letter, a number, white space, or (0) anything else."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.zeros(len(every), dtype=np.uint8)
    for kind, members in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for run in regex.finditer(members, every):
            kinds[run.start():run.end()] = kind
    return kinds


def word_starts(codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where matches of ``WORDS_PATTERN`` begin: a mask over the characters (code points) of texts that begin at ``texts``, none of them empty.

    A match is a run of letters, numbers or other characters, with a space before it; of longer white space the last
    character is a match by itself or that space.  Only a contraction ends within a run.
    """
    kind = _kinds().take(codes)
    starts = np.ones(len(codes), dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts[texts] = True
    blank = kind == _SPACE
    last = blank.copy()
    last[:-1] &= ~blank[1:]
    last[texts[1:] - 1] = last[-1:] = False  # white space at the end of a text is one match
    starts |= last
    starts[1:] &= ~(last[:-1] & (codes[:-1] == ord(" ")))
    mark = np.flatnonzero((codes == ord("'")) & starts)
    ends = np.append(texts[1:], len(codes))[np.searchsorted(texts, mark, side="right") - 1]
    for size, endings in ((2, ("s", "t", "m", "d")), (3, ("re", "ve", "ll"))):
        at = mark[mark + size <= ends]
        found = np.zeros(len(at), dtype=bool)
        for ending in endings:
            found |= np.logical_and.reduce([codes[at + 1 + i] == ord(c) for i, c in enumerate(ending)])
        at = at[found]
        starts[at + 1] = False
        starts[(at + size)[at + size < len(codes)]] = True
    return starts


def cut_words(texts: list[str], whole: Sequence[int] = ()) -> tuple[pa.Array, np.ndarray]:
    """The matches of ``WORDS_PATTERN`` in all texts (a text numbered in ``whole`` is one), as bytes, and how many each text has."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    joined = "".join(texts)
    raw = joined.encode()
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    starts = word_starts(codes, (ends - sizes)[sizes > 0])
    for i in whole:
        starts[int(ends[i] - sizes[i]) + 1:int(ends[i])] = False
    at = np.flatnonzero(starts)
    counts = np.diff(np.searchsorted(at, ends), prepend=0)
    if len(raw) > len(codes):
        at = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)[at]
    borders = np.append(at, len(raw))
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(borders), pa.py_buffer(raw)]), counts


@functools.cache
def cutter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of ``pattern`` in a text."""
    if pattern != WORDS_PATTERN:
        return regex.compile(pattern).findall
    return lambda text: [piece.decode() for piece in cut_words([text])[0].to_numpy(zero_copy_only=False)]


class _Numbers(dict):
    """The number of each piece met; new ones are noted."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n


class Pieces:
    """Encodes texts piece by piece and remembers the ids of pieces met before, up to ``MEMORY`` bytes or a share of that.

    Texts are cut by the pattern, many short ones together; each different piece of them is looked up once.  A long text is cut
    in windows: with ``WORDS_PATTERN`` no match goes on from a character that is no white space to a space, and none looks
    back, so a text may be cut there.
    """

    def __init__(self, pattern: str, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], whole: Callable[[str], bool] | None = None,
                 share: int = 1):
        """``encode``: pieces -> their ids, one after another, and how many each has.  ``whole``: texts that are one piece.
        ``share``: how many of these a task may have, which divide ``MEMORY``."""
        self.find, self.cuts = cutter(pattern), pattern == WORDS_PATTERN
        self.encode, self.whole, self.share = encode, whole, share
        self.numbers, self.bytes, self.longest = _Numbers(), 0, 0
        self.ids, self.sizes, self.hits = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where those of each begin."""
        out, sizes = [np.zeros(0, dtype=np.int32)], np.zeros(len(texts), dtype=np.int64)
        held, owner, whole, size = [], [], [], 0
        for i, text in enumerate(texts):
            one = self.whole is not None and self.whole(text)
            for part in [text] if one or not self.cuts else self._windows(text):
                if size and size + len(part) > WINDOW:
                    out.append(self._encode(held, owner, whole, sizes))
                    held, owner, whole, size = [], [], [], 0
                if one:
                    whole.append(len(held))
                held.append(part)
                owner.append(i)
                size += len(part)
        if held:
            out.append(self._encode(held, owner, whole, sizes))
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])

    def _windows(self, text: str) -> Iterator[str]:
        """A text in parts of about ``WINDOW`` characters, cut where no piece is."""
        at = 0
        while len(text) - at > WINDOW:
            cut = _CUT.search(text, at + WINDOW)
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end
        if at < len(text):
            yield text[at:]

    def _pieces(self, parts: list[str], whole: list[int]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all parts (one numbered in ``whole`` is a piece), and how many each has."""
        if self.cuts:
            return cut_words(parts, whole)
        ones = set(whole)
        found = [[part] if i in ones else self.find(part) for i, part in enumerate(parts)]
        return pa.array([piece.encode() for piece in chain.from_iterable(found)], pa.large_binary()), np.array([len(x) for x in found], dtype=np.int64)

    def _encode(self, parts: list[str], owner: list[int], whole: list[int], sizes: np.ndarray) -> np.ndarray:
        """The ids of all parts; new pieces are encoded, and the number of ids is added to ``sizes`` of each part's owner."""
        cut, counts = self._pieces(parts, whole)
        found = cut.dictionary_encode()
        different, where = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        numbers = np.fromiter(map(self.numbers.__getitem__, different), dtype=np.int64, count=len(different))
        fresh, self.numbers.fresh = self.numbers.fresh, []
        for i in range(0, len(fresh), FLUSH):
            some = fresh[i:i + FLUSH]
            ids, n = self.encode(some)
            self.ids, self.sizes = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.sizes, n])
            self.bytes += 4 * len(ids) + 200 * len(some) + sum(map(len, some))
            self.longest = max(self.longest, max(map(len, some)))
        self.hits = np.append(self.hits, np.zeros(len(fresh), dtype=np.int64))
        self.hits[numbers] += np.bincount(where, minlength=len(different))
        starts = (np.cumsum(self.sizes) - self.sizes)[numbers]
        n = self.sizes[numbers][where]
        ends = np.cumsum(n)
        out = self.ids[gather(starts[where], n, ends)]
        np.add.at(sizes, owner, np.diff(np.append(0, ends)[np.cumsum(counts)], prepend=0))
        full = self.bytes > MEMORY // self.share
        if full or self.longest > LONG:
            self._forget(full)
        return out

    def _forget(self, many: bool) -> None:
        """Long pieces go; if ``many``, so do those met once and the rarer half."""
        keys = list(self.numbers)  # in the order of their numbers
        kept = np.argsort(-self.hits, kind="stable")[:len(keys) // 2] if many else np.arange(len(keys))
        kept = [i for i in kept.tolist() if len(keys[i]) < LONG and (self.hits[i] > 1 or not many)]
        keys, old = [keys[i] for i in kept], np.array(kept, dtype=np.int64)
        starts, sizes = (np.cumsum(self.sizes) - self.sizes)[old], self.sizes[old]
        self.ids, self.sizes, self.hits = self.ids[gather(starts, sizes, np.cumsum(sizes))], sizes, self.hits[old] // 2
        self.numbers.clear()
        self.numbers.update((k, i) for i, k in enumerate(keys))
        self.longest = 0
        self.bytes = 4 * len(self.ids) + 200 * len(keys) + sum(map(len, keys))


class Pairs:
    """(left id, right id) -> id of the merged token, in an open-addressing table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.values = np.full(1 << self.bits, NO_RANK, dtype=np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == np.iinfo(np.uint64).max
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of several for one slot the last stays
            placed = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[placed]]] = merged[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (W.mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NO_RANK for pairs that do not merge (a negative id merges with nothing)."""
        out = np.full(left.shape, NO_RANK, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[todo].astype(np.uint64) << np.uint64(32) | right.ravel()[todo].astype(np.uint64)
        slot = self._slot(keys)
        flat = out.ravel()
        while len(todo):
            there = self.keys[slot]
            same = there == keys
            flat[todo[same]] = self.values[slot[same]]
            on = ~same & (there != np.iinfo(np.uint64).max)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


class Vocabulary:
    """Encodes and decodes; the half that encodes is built when it is first used, since some workers only decode."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.pattern = pattern
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        size = max(self.ranks.values(), default=-1) + 1
        self.lengths = np.zeros(size, dtype=np.int64)
        token = [b""] * size
        for t, n in self.ranks.items():
            self.lengths[n], token[n] = len(t), t
        self.flat = np.frombuffer(b"".join(token), dtype=np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    @functools.cached_property
    def pairs(self) -> Pairs:
        split = np.fromiter(chain.from_iterable(
            (self.ranks[t[:i]], self.ranks[t[i:]], n) for t, n in self.ranks.items() for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks), dtype=np.int64)
        return Pairs(*split.reshape(-1, 3).T)

    @functools.cached_property
    def single(self) -> np.ndarray:
        return np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)

    @functools.cached_property
    def encode_batch(self) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
        # Half the memory: a task has two workers, one to encode and one to decode, and over time each of them does both.
        return Pieces(self.pattern, self.merge, share=2).encode_batch

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, one after another, and how many each has."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], dtype=np.int32)
            elif len(p) > LONG:
                out[i] = self._merge_long(p)
            else:
                buckets.setdefault((len(p) + 3) // 4, []).append(i)
        for width, rows in buckets.items():
            step = CELLS // (4 * width)
            for i in range(0, len(rows), step):
                part = rows[i:i + step]
                for row, ids in zip(part, self._merge_matrix([pieces[j] for j in part], 4 * width), strict=True):
                    out[row] = ids
        sizes = np.array([len(x) for x in out], dtype=np.int64)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32), sizes

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        ids = np.full((len(pieces), width), -1, dtype=np.int32)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        sizes = np.array([len(p) for p in pieces])
        filled = np.arange(width) < sizes[:, None]
        ids[filled] = self.single[raw[filled]]
        rank = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(pieces))
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        while len(row):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), dtype=np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NO_RANK, dtype=np.int32)
            done = best == NO_RANK
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    out[row[i]] = ids[i][ids[i] >= 0].copy()
                on = ~done
                row, ids, rank, at, best = row[on], ids[on], rank[on], at[on], best[on]
                if not len(row):
                    break
            r = np.arange(len(row))
            ids[r, at] = best
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            column = np.arange(rank.shape[1] - 1)
            rank = np.take_along_axis(rank, column + (column > at[:, None]), axis=1)
            # The two pairs with the new token; each row has one column less than before.
            right = at < rank.shape[1]
            rank[r[right], at[right]] = self.pairs.rank(ids[r[right], at[right]], ids[r[right], at[right] + 1])
            left = at > 0
            rank[r[left], at[left] - 1] = self.pairs.rank(ids[r[left], at[left] - 1], ids[r[left], at[left]])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)]
        rank = self.pairs.rank(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NO_RANK:
            at = np.flatnonzero(rank == best)
            # Of overlapping pairs (as in "aaa") every second one, counted from the left of each run.
            run = np.concatenate([[True], np.diff(at) > 1])
            at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            merged = np.full(len(at), best, dtype=np.int32)
            left = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
            after_merge = np.concatenate([[False], np.diff(at) == 2])
            left[after_merge] = best
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            sooner = np.flatnonzero((self.pairs.rank(left, merged) < best) | (self.pairs.rank(merged, right) < best))
            if len(sooner):
                at = at[:sooner[0] + 1]
            stay = np.ones(len(ids), dtype=bool)
            stay[at + 1] = False
            ids = ids.copy()
            ids[at] = best
            ids = ids[stay]
            new = at - np.arange(len(at))
            rank = np.delete(rank, np.minimum(at + 1, len(rank) - 1)) if at[-1] + 1 < len(rank) else np.delete(rank, np.concatenate([at[:-1] + 1, [len(rank) - 1]]))
            touched = np.unique(np.concatenate([new, new - 1]))
            touched = touched[(touched >= 0) & (touched < len(rank))]
            rank[touched] = self.pairs.rank(ids[touched], ids[touched + 1])
        return ids

    def decode_batch(self, ids: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of runs of ids, one after another, and where those of each run begin."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.flat[gather(self.starts[ids], sizes, ends)], np.concatenate([[0], ends])[borders]


def gather(starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of many runs, given where each starts and its size; ``ends`` is the running sum of the sizes."""
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


_loaded: dict[tuple[int, str], Vocabulary] = {}


def _vocabulary(content: Broadcast, pattern: str) -> Vocabulary:
    """Built once per worker process."""
    key = (hash(content.value), pattern)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(content.value, pattern)
    return _loaded[key]


class Codec:
    """Column functions for one rank file; its content, bounded by the vocabulary, goes to the tasks by broadcast."""

    def __init__(self, spark: SparkSession, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            content = spark.sparkContext.broadcast(f.read())

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            vocabulary, parts = _vocabulary(content, pattern), []
            for part in W.slices(texts, WINDOW):
                ids, borders = vocabulary.encode_batch([t or "" for t in part.to_pylist()])
                parts.append(pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(ids)))
            return pa.concat_arrays(parts)

        @F.arrow_udf("binary")
        def decode(ids: pa.Array) -> pa.Array:
            vocabulary, parts = _vocabulary(content, pattern), []
            for i in range(0, max(1, len(ids)), 256):
                part = ids.slice(i, 256)
                sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                borders = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                data, at = vocabulary.decode_batch(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), borders)
                parts.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]))
            return pa.concat_arrays(parts)

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        """array<int>: ids of the whole text."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """binary: the bytes that the ids stand for."""
        return self._decode(ids)
