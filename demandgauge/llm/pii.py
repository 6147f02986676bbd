"""Personal data: four fixed patterns, and names of persons found by a conditional random field.

The patterns (e-mail, ip, card, phone) are base spans and always stay.  The field reads white-space
tokens of a sentence: shape of the word, the word itself if it occurs in the training table, and both for its
neighbours.  The table is small and made by rule from lists of names, surroundings and
plain sentences; another one can be given.  A found name that overlaps a base span is left out.

Features are computed on bytes for whole batches; sentences are decoded in padded batches.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive,
ordered by start, then by kind as in ``KINDS``; equal rows give equal spans.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from demandgauge.llm import words as W
from demandgauge.llm.crf import Crf

KINDS = ["email", "ip", "card", "phone", "name"]
N_BASE = 4

# Fixed values of the contract.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always begins a run of digits: a look-behind spares the other starts, which a long run has many of.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds them, but led by the @, which is rare."""
    out, free = [], 0
    for m in _AT.finditer(text):
        begin = m.start()
        while begin > free and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        if begin < m.start():
            out.append((begin, m.end()))
            free = m.end()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the four patterns."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        size = m.end() - m.start()
        if size >= 12:
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), m.end(), 3))
    return out


# --- names --------------------------------------------------------------------------------------

_GIVEN = ("James Mary Robert Linda Michael Susan David Karen Thomas Nancy Daniel Laura Peter Anna Paul Julia Mark Sarah Hans Sophie Pierre Claire "
          "Carlos Lucia Ahmed Fatima Wei Priya").split()
_FAMILY = ("Smith Johnson Brown Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson Clark Lewis Walker Schmidt Weber Dubois Garcia Lopez "
           "Khan Chen Singh Novak").split()
_AROUND = ["my name is {}", "please contact {} for details", "ask for {} at the desk", "Dear Mr. {}", "Dear Ms. {}", "Dear {}", "call {} at the office", "written by {} in May",
           "regards, {}", "Dr. {} was there", "Mrs. {} lives here", "Mr. {} said so", "signed {}", "the patient {} was seen",
           # surroundings that say little: only listed names stand here
           "sent from {} to {}", "{} wrote this letter", "{} and {} met there"]
_WEAK = 3
_PLAIN = ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "The Paris Office was closed",
          "Was of the. Ontion and Thering is here", "Please contact the office for details", "ask for help at the desk", "call us at the number", "My name is not known",
          "written by hand in May", "The letter was sent from Berlin to Rome", "General terms apply", "Dear customer", "regards, the team", "MIT License",
          "And the Inheed was in of. The Anding", "token = \"abc\" of the", "New York and Los Angeles", "On Monday the Bank of England met", "by the river", "Contact Sales Support"]


def labelled_sentences(n: int = 720) -> list[tuple[list[str], list[int]]]:
    """Tokens and labels (0 outside, 1 first of a name, 2 further) of sentences made by rule."""
    rnd, out = random.Random(13), []
    unknown = lambda: "".join(rnd.choice("aeioubdlmnrst") for _ in range(rnd.randrange(3, 8)))
    for i in range(n):
        if i % 2:
            tokens, labels = [], []
            around = i // 2 % len(_AROUND)
            listed = 1.0 if around >= len(_AROUND) - _WEAK else 0.4
            for w in _AROUND[around].split():
                if "{}" in w:
                    names = [rnd.choice(_GIVEN) if rnd.random() < listed else unknown().capitalize(), rnd.choice(_FAMILY) if rnd.random() < listed else unknown().capitalize()]
                    names = names[rnd.random() < 0.3:]
                    names[-1] += rnd.choice(["", "", "", ",", "."])
                    tokens += names
                    labels += [1] + [2] * (len(names) - 1)
                else:
                    tokens.append(w)
                    labels.append(0)
        elif i % 4:
            tokens = _PLAIN[i // 4 % len(_PLAIN)].split()
            labels = [0] * len(tokens)
        else:
            # Sentences that say nothing: capitals alone, repeated, or before a comma or full stop.
            w = unknown()[:rnd.randrange(2, 8)].capitalize()
            more = [unknown() + rnd.choice(["", "", ","]) for _ in range(rnd.randrange(0, 8))]
            said = rnd.choice(["by", "for", "at", "to", "from", "is", "call", "ask", "contact", "of", "a", "and"])
            tokens = rnd.choice([[w + "."], [w] * rnd.randrange(2, 9), [said.capitalize()] * rnd.randrange(2, 9), ["A", w + "."], [w, *more, unknown() + "."], [w, unknown().capitalize(), *more], [w + ",", *more, unknown() + "."],
                                 [w + ",", unknown().capitalize() + "."], [*more, w], [*more, w + ","], [w.upper() + "!!"] * 3, [unknown(), "|", w, "|", unknown()],
                                 *[[*more, said, unknown(), *more]] * 2,
                                 [rnd.choice(["The", "In", "To", "And", "Of"]), *more, w, "the", *more]])
            labels = [0] * len(tokens)
            if rnd.random() < 0.6:
                out.append((tokens, labels))
                continue
        # plain words before and after, some of them with capitals or full stops
        for side in (0, 1):
            for _ in range(rnd.randrange(0, 7)):
                w = rnd.choice([unknown(), "the", "of", "and", "in", "to", unknown().capitalize(), unknown() + ",", unknown() + ".", unknown().upper() + "!!"])
                tokens, labels = (tokens + [w], labels + [0]) if side else ([w] + tokens, [0] + labels)
        out.append((tokens, labels))
    return out


_N_SHAPES = 128
_UPPER, _DIGIT = W.byte_class([(0x41, 0x5A)]), W.byte_class([(0x30, 0x39)])
_MARK = W.byte_class([(ord(c), ord(c)) for c in "@/\\=_<>{}[]#$%&*|\"!?"])
_STOP = W.byte_class([(ord(c), ord(c)) for c in ".!?"])
_PAUSE = W.byte_class([(ord(c), ord(c)) for c in ",;:"])


_TITLES = W.Words(pa.array(["mr. mrs. ms. dr. prof. st. hr. fr. sr. sra. mme."]), W.SPACE).hashes()


class NameFinder:
    """The trained field with its vocabulary; small, so it travels with the function."""

    def __init__(self, sentences: list[tuple[list[str], list[int]]]):
        every = W.Words(pa.array([" ".join(t) for t, _ in sentences]), W.SPACE)
        names = np.unique(every.hashes())
        self.known = names
        v = len(names) + 1
        self.crf = Crf([v, 2 * v, 2 * v, _N_SHAPES, _N_SHAPES, _N_SHAPES], 3)
        features, first = self._features(every)
        x = np.stack(features, axis=1)
        spans = zip(every.first[:-1], every.first[1:], strict=True)
        self.crf.fit([x[a:b] for a, b in spans], [np.array(t) for _, t in sentences])

    def _features(self, words: W.Words) -> tuple[list[np.ndarray], np.ndarray]:
        """Feature numbers of each token, and where sentences begin (a sentence never leaves its text)."""
        data, starts, ends, n = words.data, words.starts, words.ends, len(words.starts)
        if not n:
            return [np.zeros(0, dtype=np.int64)] * 6, np.zeros(1, dtype=np.int64)
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        word = np.where(self.known[at] == h, at + 1, 0)
        count = lambda table: np.add.reduceat(table[data[:ends[-1]]], starts, dtype=np.int32) > 0
        last = data[ends - 1]
        size = ends - starts
        shape = (_UPPER[data[starts]] * 1 + (np.add.reduceat(_UPPER[data[:ends[-1]]], starts, dtype=np.int32) > 1) * 2 + count(_DIGIT) * 4 + count(_MARK) * 8
                 + _STOP[last] * 16 + _PAUSE[last] * 32 + (size <= 3) * 64)
        new = np.zeros(n, dtype=bool)
        new[words.first[:-1][np.diff(words.first) > 0]] = True
        # A sentence ends at a full stop (not after a title or an initial) and at a line break.
        new[1:] |= _STOP[last[:-1]] & (size[:-1] > 2) & ~np.isin(h[:-1], _TITLES)
        lines = np.concatenate([[0], np.cumsum(data == 0x0A, dtype=np.int32)])
        new[1:] |= lines[starts[1:]] > lines[starts[:-1]]
        first = np.append(np.flatnonzero(new), n)
        before = lambda f: np.where(new, 0, np.concatenate([[0], f[:-1]]))
        after = lambda f: np.where(np.append(new[1:], True), 0, np.append(f[1:], 0))
        capital = shape & 1  # neighbouring words say something else beside a capital than beside a small letter
        return [word, 2 * before(word) + capital, 2 * after(word) + capital, shape, before(shape), after(shape)], first

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int]]]:
        """Names of each text as (start, end) in code points, outer punctuation left off."""
        words = W.Words(texts, W.SPACE)
        features, first = self._features(words)
        label = self.crf.decode(self.crf.emissions(features), first) if len(words.starts) else np.zeros(0, dtype=np.int8)
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(words.first) - 1)]
        named = np.flatnonzero(label == 1)
        segment = np.searchsorted(first, named, "right")
        for i, s in zip(named.tolist(), segment.tolist(), strict=True):
            j = i + 1
            while j < first[s] and label[j] == 2:
                j += 1
            doc = int(np.searchsorted(words.first, i, "right")) - 1
            whole = words.data[words.offsets[doc]:words.ends[j - 1]].tobytes()
            begin = words.starts[i] - words.offsets[doc]
            name = whole[begin:].decode("utf-8", "replace")
            start = len(whole[:begin].decode("utf-8", "replace"))
            bare = name.strip("\"'(),.;:!?[]")
            if bare:
                start += name.index(bare)
                out[doc].append((start, start + len(bare)))
        return out


def spans_of(texts: pa.Array, names: NameFinder) -> list[list[tuple[int, int, int]]]:
    out = []
    for part in W.slices(texts):
        for text, found in zip(part.to_pylist(), names.spans(part), strict=True):
            base = base_spans(text or "")
            more = [(a, b, 4) for a, b in found if all(b <= x or y <= a for x, y, _ in base)]
            out.append(sorted(base + more, key=lambda s: (s[0], s[2])))
    return out


class Finder:
    """Column functions; trains the field once, on the driver, from the small labelled table."""

    def __init__(self, spark: SparkSession, sentences: list[tuple[list[str], list[int]]] | None = None):
        shared = spark.sparkContext.broadcast(NameFinder(sentences or labelled_sentences()))

        @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
        def spans(texts: pa.Array) -> pa.Array:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in row] for row in spans_of(texts, shared.value)]
            return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

        @F.arrow_udf("string")
        def masked(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else mask(t, s) for t, s in zip(texts.to_pylist(), spans_of(texts, shared.value), strict=True)], pa.string())

        self._spans, self._masked = spans, masked

    def spans(self, text: Column) -> Column:
        """array of (kind, start, end)"""
        return self._spans(text)

    def masked(self, text: Column) -> Column:
        """The text with each span, or run of overlapping spans, replaced by the first one's kind; null stays null."""
        return self._masked(text)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
