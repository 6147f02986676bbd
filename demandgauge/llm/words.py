"""Words and word hashes of whole batches of texts, computed on the UTF-8 bytes of an Arrow array.

Separators are ASCII in every contract served here, so a byte table decides what is a word.
Hashes are 64 bits wide: a polynomial over random byte values, mixed at the end.  Bytes are
worked through in pieces of about ``_PIECE``, so temporary arrays stay small however long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PIECE = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64)


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes in ``ranges``, which are inclusive."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: The word separators of the contracts: white space, and all ASCII that is no letter or digit.
SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
NOT_ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_pow = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inverse
    if len(_pow) < n:
        with np.errstate(over="ignore"):
            _pow, _inverse = (
                np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x)]), dtype=np.uint64) for x in (_P, _P_INVERSE)
            )
    return _pow, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of ``x`` over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offsets of each; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most: int = 1 << 22) -> list[pa.Array]:
    """Runs of whole texts of about ``most`` bytes; a longer text is a run by itself."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0)
    cuts, at = [0], 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        at = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        cuts.append(at)
    return [texts.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] or [texts]


class Words:
    """Words of a batch: ``starts`` and ``ends`` in bytes, and ``first``, where the words of text i begin."""

    def __init__(self, texts: pa.Array, separators: np.ndarray):
        self.data, self.offsets = text_bytes(texts)
        inside = ~separators[self.data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        begin[edges] = inside[edges]
        edges = edges[edges > 0] - 1
        end[edges] = inside[edges]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same for A-Z and a-z."""
        values = _BYTE[LOWER]
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        with np.errstate(over="ignore"):
            while at < len(out):
                base = self.starts[at]
                to = max(at + 1, int(np.searchsorted(self.ends, base + _PIECE, "right")))
                piece = values[self.data[base:self.ends[to - 1]]]
                power, inverse = _powers(len(piece) + 1)
                sums = np.zeros(len(piece) + 1, dtype=np.uint64)
                np.cumsum(piece * power[:len(piece)], out=sums[1:])
                s, e = self.starts[at:to] - base, self.ends[at:to] - base
                out[at:to] = mix((sums[e] - sums[s]) * inverse[s])
                at = to
        return out

    def of_word(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def lowered(self, first: int, last: int, separators: bytes) -> list[str]:
        """The words first..last-1, A-Z lower-cased; they must be of one text."""
        if first >= last:
            return []
        piece = LOWER[self.data[self.starts[first]:self.ends[last - 1]]].tobytes()
        return piece.translate(separators).decode("utf-8", "replace").split(" ") if last - first == 1 else [
            w for w in piece.translate(separators).decode("utf-8", "replace").split(" ") if w]


def to_space(separators: np.ndarray) -> bytes:
    """A table for ``bytes.translate`` that turns separators into spaces."""
    return bytes(0x20 if sep else b for b, sep in enumerate(separators))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words, also of those that cross from one text to the next."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for j in range(1, k):
            out *= _Q
            out += hashes[j:j + n]
        return mix(out)


def inside(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """For each start of a run of ``k`` words, whether the run stays within one text."""
    n = n_words - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    return left >= k
