import hashlib
import random
import re
import time

import pyarrow as pa
import pytest

from demandgauge.llm import pii
from demandgauge.llm.crf import Crf
from demandgauge.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def test_base_patterns():
    rnd = random.Random(4)
    bits = ["a", "é", "x.y", "@", "@", ".", "..", "-", "+", "%", "1", "4", "255", "256", "0300", "192.168.0.1", "4111 1111 1111 1111", "4111-1111", " ", "\n", "(", ")",
            "+1 (843) 555-4223", "me@host.example.com", "_", "007.1.2.3"]
    for _ in range(20_000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 14)))
        assert joined(pii.base_spans(text)) == brute(text), text


def test_base_patterns_on_very_long_runs():
    """A megabyte of one kind of character takes a time in proportion to its length."""
    n = 1_000_000
    tail = " me@host.example 10.0.0.1"
    for run in ("7" * n, "1." * (n // 2) + "x", "1.2.3" * (n // 5) + "x", "12345.12345.12345." * (n // 18), "a" * n, "a@" * (n // 2), "@a-" * (n // 3), "+1" + " " * n, "+1(" * (n // 3), "4 " * (n // 2)):
        begun = time.perf_counter()
        found = pii.base_spans(run + tail)
        assert time.perf_counter() - begun < 20, run[:20]
        assert any(k == 0 and (run + tail)[a:b].endswith("me@host.example") for a, b, k in found), run[:20]


@pytest.fixture(scope="module")
def names():
    return pii.NameFinder(pii.labelled_sentences())


def test_names_held_out(names):
    """Names that the training table does not hold, and texts without names."""
    right = {"my name is Orlando Quimby and so on": "Orlando Quimby", "é so please contact Beatrix Potter for details": "Beatrix Potter",
             "Dear Mr. Haverford, we write": "Haverford", "Mrs. Okonkwo lives here": "Okonkwo", "ask for Elspeth McGill at the desk": "Elspeth McGill"}
    found = {text: [text[a:b] for a, b in names.spans(pa.array([text]))[0]] for text in right}
    assert all(name in right[t] for t in right for name in found[t]), found
    assert sum(bool(found[t]) for t in right) >= 4, found
    plain = ["Licensed under the Apache License, Version 2.0.", "Ontion thering of the. Wand in Thandor is", "", None, "THE END!! OF!! IT!!", "Die. Der. Das ist so", "x " * 5000]
    assert names.spans(pa.array(plain)) == [[] for _ in plain]


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np
    rng = np.random.default_rng(0)
    for _ in range(50):
        crf = Crf([1], 3)
        crf.step = rng.normal(size=(3, 3))
        sizes = rng.integers(0, 7, 5)
        e, first = rng.normal(size=(int(sizes.sum()), 3)) - [0, 1.5, 1.5], np.concatenate([[0], np.cumsum(sizes)])
        got = crf.decode(e, first)
        for a, b in zip(first[:-1], first[1:], strict=True):
            score = lambda p: sum(e[a + i, y] for i, y in enumerate(p)) + sum(crf.step[x, y] for x, y in zip(p, p[1:]))  # noqa: B023, E731
            best = max(itertools.product(range(3), repeat=int(b - a)), key=score)
            assert abs(score(best) - score(tuple(got[a:b]))) < 1e-9


def test_edge_rows(spark):
    finder = pii.Finder(spark)
    texts = ["é me@a.b, write to Mr. Peter Smith", None, "", "+1 (843) 555-4223 and 4111111111111111", "word " * 30_000 + "a@b.c"]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[0])], "doc_id bigint, text string").repartition(3).selectExpr("*", "1 AS spans", "2 AS kind")
    rows = df.select("doc_id", finder.spans(df["text"]).alias("found"), finder.masked(df["text"]).alias("masked")).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 7 and got[None].found == got[0].found
    assert [(s.kind, texts[0][s.start:s.end]) for s in got[0].found] == [("email", "me@a.b"), ("name", "Peter Smith")]
    assert got[0].masked == "é [EMAIL], write to Mr. [NAME]" and got[3].masked == "[PHONE] and [CARD]"
    assert (got[1].found, got[1].masked, got[2].found, got[2].masked) == ([], None, [], "")
    assert [(s.start, s.end) for s in got[4].found] == [(150_000, 150_005)]
    assert df.limit(0).select(finder.spans(df["text"])).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op8_pii"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if not x.startswith("name")] == want.split(",")  or not want
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(k + ":") for k in pii.KINDS[:4])
