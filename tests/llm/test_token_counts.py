"""Token counts against the unchanged library, with chunks small enough to be spliced everywhere."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from demandgauge.llm import token_counts as T
from demandgauge.llm.queries import op13_token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def made_texts():
    rng = random.Random(5)
    kinds = ["abc ", "a", " ", "ab", "the state of things, ", "é世界", "\U0001f600x", "0123456789", "▁ _", "</s><unk>\n\t", "한국 ᄀ"]
    texts = [None, "", " ", "x", "a" * 1000, " " * 777, "=" * 513 + "ab" * 300, "\U0001f600" * 200, "ab " * 400]
    for _ in range(60):
        kind = rng.choice(kinds) + rng.choice(kinds)
        texts.append("".join(rng.choice(kind) for _ in range(rng.randrange(1, 900))))
    return texts


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 8), (64, 64), (100, 1), (300, 30)])
def test_equals_library(spark, library, chunk, overlap):
    texts = made_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in T.count_tokens(docs, MODEL, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(texts)}


def test_seams_that_agree_are_not_widened(spark, library, monkeypatch):
    text = " ".join(random.Random(1).choices(["plain", "words", "of", "prose,", "unaffected"], k=3000))
    monkeypatch.setattr(T, "WIDER", None)  # another round would fail
    docs = spark.createDataFrame([(1, text)], SCHEMA)
    assert T.count_tokens(docs, MODEL, chunk=500, overlap=60).head()["n_tokens"] == len(library.encode(text))


def test_common_token_proof_on_the_model(library):
    """Splices at every common token of random overlaps, not only the first."""
    pieces, rng = T.Pieces(open(MODEL, "rb").read()), random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab  1e.sté世") for _ in range(120))
        whole, (a, b) = pieces.ends(text).tolist(), (rng.randrange(10, 60), rng.randrange(70, 119))
        left, right = pieces.ends(text[:b]).tolist(), [e + a for e in pieces.ends(text[a:]).tolist()]
        spans = [set(zip([-1, *x[:-1]], x)) for x in (left, right)]
        for begin, end in spans[0] & spans[1]:
            if a <= begin < end:
                assert left[:left.index(end) + 1] + right[right.index(end) + 1:] == whole


def test_repeated_rows_clashing_names_and_empty_table(spark, library):
    text = "one two " * 100
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], SCHEMA).withColumns(
        {"n_tokens": F.lit("old"), "_i": F.lit(1), "n": F.lit(2)})
    got = T.count_tokens(docs, MODEL, chunk=50, overlap=10)
    assert sorted(got.columns) == sorted(["doc_id", "text", "_i", "n", "n_bytes", "n_tokens"])
    assert sorted(r.n_tokens for r in got.collect()) == [0] + [len(library.encode(text))] * 3
    assert T.count_tokens(docs.filter("false"), MODEL).collect() == []


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op13_token_counts(spark, folder).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
        i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}
