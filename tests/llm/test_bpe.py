import base64
import hashlib
import random

import public_tokenizers as P
import regex
import tiktoken

from demandgauge.llm import bpe
from demandgauge.llm.bpe import Codec, Vocabulary
from demandgauge.llm.queries import QUERIES

FILE = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(2)
    out = [None, "", " ", "\n\n  \t", "a", "<|endoftext|>", "Straße 12345678 don't WE'LL", "日本語のテキスト" * 9, "\U0001F600" * 70, "é" * 301,
           "a" * 5000, "ab" * 700, "abc" * 400 + "abcab", "x" * 257, " " * 3000, "0123456789" * 90, "=" * 777, "thethethe" * 60]
    alphabet = "aabbcdeilnorst ,.'éüñ漢0189=-_\n\t"
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([3, 40, 400]))) for _ in range(200)]
    out += ["".join(rnd.choice("etaoinshr") for _ in range(n)) for n in (200, 255, 256, 258, 700, 3000)]
    out += ["".join(chr(rnd.randrange(1, 0xD000)) for _ in range(500)) for _ in range(5)]
    return out


def test_as_the_library(spark):
    codec, lib = Codec(spark, FILE, P.PATTERN), library()
    rows = list(enumerate(texts())) + [(0, None), (7, texts()[7])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).selectExpr("*", "1 AS ids_", "2 AS n")
    got = df.withColumn("ids", codec.encode(df["text"]))
    got = got.withColumn("back", codec.decode(got["ids"])).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == lib.encode_ordinary(r.text or ""), r.text
        assert bytes(r.back) == (r.text or "").encode()
    assert df.limit(0).select(codec.encode(df["text"])).collect() == []


def test_rounds_with_tokens_whose_parts_rank_higher():
    """Vocabularies in which a longer token ranks before its parts, so that order within a round matters."""
    rnd = random.Random(11)
    for _ in range(60):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 256 + 40:
            tokens.add(bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(2, 7))))
        longer = sorted(t for t in tokens if len(t) > 1)
        rnd.shuffle(longer)
        ranks = {bytes([b]): i for i, b in enumerate(range(256))} | {t: 256 + i for i, t in enumerate(longer)}
        file = b"\n".join(base64.b64encode(t) + b" %d" % n for t, n in ranks.items())
        ours, lib = Vocabulary(file, r"[\s\S]+"), tiktoken.Encoding("x", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        many = ["".join(rnd.choice("aabc") for _ in range(n)) for n in (1, 2, 5, 17, 90, 250, 300, 600)]
        ids, at = ours.encode_batch(many)
        for text, a, b in zip(many, at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == lib.encode_ordinary(text)


def test_windows_and_memory(monkeypatch):
    """Small windows, small memory and long pieces give the same ids; what is remembered stays small."""
    for name, value in (("WINDOW", 40), ("MEMORY", 20_000), ("FLUSH", 7)):
        monkeypatch.setattr(bpe, name, value)
    ours, lib, rnd = Vocabulary(open(FILE, "rb").read(), P.PATTERN), library(), random.Random(6)
    pieces = ours.encode_batch.__self__
    spaces = [" ", " ", " ", "  ", "\n", " \n", "\n ", "\u3000 ", " \u00a0", "\x1c ", "\x85 ", " \u180e ", "\t\t", "   "]
    many = ["".join(rnd.choice(["word", "don't", "x1", "é", "...", "漢字", "a" * 300, str(rnd.random())]) + rnd.choice(spaces) for _ in range(60)) for _ in range(150)]
    many += texts()[1:] + [" " + t for t in many[:20]] + [t.strip() for t in many[:20]]
    for batch in (many[:50], many[50:], many[::3]):
        ids, at = ours.encode_batch(batch)
        for text, a, b in zip(batch, at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == lib.encode_ordinary(text), text
        assert pieces.bytes <= 20_000 and len(pieces.numbers) < 200


def test_query(spark):
    folder, lib = "/root/testdata/sf0.001", library()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op3_bpe"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = lib.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_cutter_equals_the_pattern():
    """Python's re finds what the pattern finds: over all characters, and in random mixes of them."""
    rnd, own = random.Random(5), regex.compile(P.PATTERN).findall
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    odd = "'s't're've'm'll'd 'S''r v1\u00b2\u0660a\u0301 \t\n\r\x0b\x1c\x85\xa0\u180e\u2003\u3000\u2028_-.\u4e00\u2160\U0001F600\U00010400"
    mixes = ["".join(rnd.choice(odd) for _ in range(60)) for _ in range(2000)] + ["".join(rnd.choices(every, k=200)) for _ in range(200)]
    for text in [every, every[:0xF800], *(" ".join(every[i:i + 5000]) for i in range(0, 0xF800, 5000)), *mixes, *(t or "" for t in texts())]:
        assert bpe.cutter(P.PATTERN)(text) == own(text)
    assert bpe.cutter(r"[a-z]+")("ab 1") == ["ab"]


def test_merging_many_wide_pieces_stays_small(monkeypatch):
    """A matrix is bounded in cells, not in rows; wide pieces took gigabytes a worker when many came at once."""
    vocabulary, rnd, widest = Vocabulary(open(FILE, "rb").read(), P.PATTERN), random.Random(3), []
    merge = Vocabulary._merge_matrix
    monkeypatch.setattr(Vocabulary, "_merge_matrix", lambda self, pieces, width: widest.append(len(pieces) * width) or merge(self, pieces, width))
    pieces = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(250)) for _ in range(1200)]
    ids, borders = vocabulary.encode_batch([" ".join(pieces)])
    assert max(widest) <= 1 << 17
    assert ids.tolist() == library().encode(" ".join(pieces), disallowed_special=())


def test_decoding_builds_no_pairs():
    vocabulary = Vocabulary(open(FILE, "rb").read(), P.PATTERN)
    assert bytes(vocabulary.decode_batch(bpe.np.array([5, 300]), bpe.np.array([0, 2]))[0]) and "pairs" not in vars(vocabulary)


def test_texts_are_cut_together():
    """Many texts at once are cut as each alone, also where a text ends in white space or an apostrophe, is empty, or is one piece."""
    rnd, own = random.Random(9), regex.compile(P.PATTERN).findall
    odd = "'s't're've'm'll'd 'S''r v1²٠á \t\n\r\x0b\x1c\x85\xa0᠎ 　 _-.一Ⅰ\U0001F600\U00010400"
    many = ["", "", "a ", "b", "it'", "s", " 'r", "e", "x'l", "l", "　", " y", "", "'", "'re", "'v", "ends  "]
    many += ["".join(rnd.choice(odd) for _ in range(rnd.randrange(8))) for _ in range(3000)] + [""]
    pieces, counts = bpe.cut_words(many)
    found, ends = [piece.decode() for piece in pieces.to_pylist()], bpe.np.cumsum(counts).tolist()
    assert [found[b - n:b] for n, b in zip(counts.tolist(), ends, strict=True)] == list(map(own, many))
    pieces, counts = bpe.cut_words(["a b", "é c d", "", "e f"], whole=[1])
    assert pieces.to_pylist() == [b"a", b" b", "é c d".encode(), b"e", b" f"] and counts.tolist() == [2, 1, 0, 2]
    assert bpe.cut_words(["", ""])[1].tolist() == [0, 0]


def test_a_piece_is_looked_up_once_for_many_texts(monkeypatch):
    """Work in Python grows with the different pieces of a window, not with all of them."""
    asked = []
    monkeypatch.setattr(bpe._Numbers, "__getitem__", lambda self, piece: asked.append(piece) or (
        dict.__getitem__(self, piece) if piece in self else self.__missing__(piece)), raising=False)
    ours, many = Vocabulary(open(FILE, "rb").read(), P.PATTERN), ["one two, one three"] * 500 + [""] + ["two one"] * 500
    ids, at = ours.encode_batch(many)
    assert len(asked) == len(set(asked)) == 6
    expected = {text: library().encode_ordinary(text) for text in set(many)}
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [expected[text] for text in many]
