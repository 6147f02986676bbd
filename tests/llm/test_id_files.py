import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from demandgauge.llm import id_files
from demandgauge.llm.queries import QUERIES


def optimal_cost(counts, most):
    """Least total length, from all multisets of lengths that satisfy Kraft's sum (small inputs)."""
    counts = sorted((c for c in counts if c), reverse=True)
    best = [float("inf")]

    def go(i, last, room, cost):
        if cost >= best[0] or room < 0:
            return
        if i == len(counts):
            best[0] = cost
            return
        for n in range(last, most + 1):
            go(i + 1, n, room - 2 ** (most - n), cost + n * counts[i])
    go(0, 1, 2 ** most, 0)
    return best[0]


def test_lengths_are_optimal_and_limited():
    rnd = random.Random(3)
    for _ in range(60):
        most = rnd.choice([3, 4, 5])
        counts = np.array([rnd.choice([0, 1, 1, 2, 5, 30, 900]) for _ in range(rnd.randrange(2, 8))])
        lengths = id_files.code_lengths(counts, most)
        if (counts > 0).sum() > 1:
            assert lengths.max() <= most
            assert (lengths > 0).tolist() == (counts > 0).tolist()
            assert (lengths.astype(int) * counts).sum() == optimal_cost(counts.tolist(), most)


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
@pytest.mark.parametrize("vocabulary", [1, 3, 50_000])
def test_round_trip(n, vocabulary):
    ids = (np.random.default_rng(n).pareto(0.7, n) * 3).astype(np.int64) % vocabulary
    lengths = id_files.code_lengths(np.bincount(ids, minlength=vocabulary))
    payload, checkpoints = id_files.pack(ids, id_files.codes(lengths), lengths)
    assert len(checkpoints) == -(-n // id_files.STEP)
    assert id_files.Table(lengths).unpack(payload, checkpoints, n).tolist() == ids.tolist()
    for k in range(1, len(checkpoints)):  # any checkpoint is a place to start from
        tail = id_files.Table(lengths).unpack(payload, checkpoints[k:], n - k * id_files.STEP)
        assert tail.tolist() == ids[k * id_files.STEP:].tolist()


def expected(docs):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, out = 0, []
    for doc, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    rows = QUERIES["op7_id_files"](spark, folder).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == expected(docs)


def test_edge_rows(spark, tmp_path):
    docs = [(None, "no id"), (-5, "first"), (1, None), (2, ""), (3, "word " * 40_000), (4, "<|endoftext|>"), (5, "same"), (5, "same"), (6, "a <|endoftext|> b"), (7, " <|endoftext|>\n<|endoftext|")]
    rnd = random.Random(8)
    docs += [(10 + i, "".join(rnd.choice("ab é'stdm\n\t  \u00a0\u3000漢字12.,!?😀-") for _ in range(rnd.randrange(1, 200)))) for i in range(300)]
    docs += [(400 + i, "".join(chr(rnd.randrange(1, 0xD000)) for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).selectExpr("*", "1 AS start", "2 AS part")
    encode = id_files.tokenizer_ids(spark, P.path("byte_bpe_50k.json"), 2, P.PATTERN)
    id_files.write_ids(df.select("doc_id", "start", "part", encode(df["text"]).alias("ids")), str(tmp_path / "a"), 50257)
    got = sorted(((r.doc_id, r.start, len(r.ids) // 4, zlib.crc32(r.ids)) for r in id_files.read_ids(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert got == expected(docs)
    id_files.write_ids(df.limit(0).select("doc_id", encode(df["text"]).alias("ids")), str(tmp_path / "b"), 50257)
    assert id_files.read_ids(spark, str(tmp_path / "b")).collect() == []


def test_blocks_are_decoded_together(monkeypatch):
    """Several blocks take the steps of one; their results are those of each alone, also for small and empty ones."""
    rng = np.random.default_rng(4)
    ids = [rng.integers(0, 400, n) ** 2 // 400 for n in (0, 3, 700, 256, 0, 5000, 1)]
    lengths = id_files.code_lengths(np.bincount(np.concatenate(ids), minlength=400))
    table, packed = id_files.Table(lengths), [id_files.pack(x, id_files.codes(lengths), lengths) for x in ids]
    steps = []
    monkeypatch.setattr(id_files, "range", lambda *a: steps.append(a) or range(*a), raising=False)
    found = table.unpack_all([p for p, _ in packed], [c for _, c in packed], [len(x) for x in ids])
    assert [x.tolist() for x in found] == [x.tolist() for x in ids] and steps == [(id_files.STEP,)]
    assert [len(x) for x in table.unpack_all([b"", b""], [np.zeros(0, np.int64)] * 2, [0, 0])] == [0, 0]


def test_ids_are_counted_by_batch(spark, monkeypatch):
    """One count of a batch's numbers, also of slices and with null rows."""
    rows = id_files.pa.array([b"\x01\x00\x02\x00", None, b"", b"\x02\x00"], id_files.pa.binary())
    assert id_files._packed(rows, "<u2").tolist() == [1, 2, 2] and id_files._packed(rows[1:], "<u2").tolist() == [2]
    assert id_files._packed(rows[1:3], "<u2").tolist() == [] and id_files._packed(rows[:0], "<u2").tolist() == []
    frame = spark.createDataFrame([(bytearray(b"\x01\x00\x02\x00"),), (None,), (bytearray(b""),), (bytearray(b"\x02\x00"),)], "ids binary")
    assert id_files.id_counts(frame, 4).tolist() == [0, 1, 2, 0]


def test_texts_with_an_added_token_among_others(monkeypatch):
    """Such a text goes to the library whole, those around it by their pieces; without one all new pieces are handed over together."""
    class Content:
        value = open(P.path("byte_bpe_50k.json"), "rb").read()

    calls, shown = [], id_files._shown
    monkeypatch.setattr(id_files, "_loaded", {})
    monkeypatch.setattr(id_files, "_shown", lambda pieces: calls.append(len(pieces)) or shown(pieces))
    own, (_, pieces) = Tokenizer.from_file(P.path("byte_bpe_50k.json")), id_files._tokenizer(Content, P.PATTERN)
    plain = ["many different words", "é\n", "", "<|endoftext|", " a  b"]
    for texts in (plain, ["x<|endoftext|> y", *plain, "<|endoftext|>", "new"]):
        ids, at = pieces.encode_batch(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [own.encode(t, add_special_tokens=False).ids for t in texts]
        assert calls[0] > 9 and len(calls) == (1 if texts is plain else 2)


def test_pieces_as_the_vocabulary_writes_them():
    every = [bytes([b]) for b in range(255)] + [b"", b"\n a\n", "é漢".encode()]
    shown = id_files._shown(every)
    assert len(shown) == len(every) and len(set(shown[:255])) == 255 and shown[255] == ""
    assert shown[256] == "ĊĠaĊ" and shown[ord("a")] == "a" and shown[0] == "Ā"
