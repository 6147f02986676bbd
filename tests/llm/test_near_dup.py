import random
import re

import pytest

from demandgauge.llm import near_dup
from demandgauge.llm.queries import QUERIES


def shingles(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, k, share):
    ids = [i for i, _ in docs]
    sets = [shingles(t, k) for _, t in docs]
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for x in range(len(docs)):
        for y in range(x):
            if sets[x] and sets[y] and ids[x] is not None and ids[y] is not None:
                both = len(sets[x] & sets[y])
                if share[1] * both >= share[0] * (len(sets[x]) + len(sets[y]) - both):
                    a, b = top(ids[x]), top(ids[y])
                    up[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else top(i), i is None or top(i) == i) for i, s in zip(ids, sets, strict=True)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def made(seed, n_hot):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [rnd.choice(vocab) for _ in range(120)]
    docs = []
    for i in range(n_hot):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 5, 9])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        docs.append((1000 - i, " ".join(w)))
    for i in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))]
        for j in range(rnd.choice([1, 1, 2, 4])):
            docs.append((2000 + 10 * i + j, " ".join(w).upper() if j == 1 else "\t".join(w)))
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
    docs += [(5000, None), (5001, ""), (5002, " \n "), (5003, "One"), (5004, "one"), (5005, "one two"), (None, docs[0][1]), (None, None),
             (5006, "x " * 9000), (5007, "X\n" * 9001), docs[3]]
    # rows of one id with different texts: the links of each of them count, also through equal texts of other ids
    near = lambda j: (lambda w: " ".join([*w[:50], "other", *w[51:]]))(docs[j][1].split())
    alone = [" ".join(rnd.choice(vocab) for _ in range(80)) for _ in range(3)]
    docs += [(6000, alone[0]), (6001, alone[0]), (6001, alone[1]), (6002, alone[1] + " end"), (6003, alone[2]), (6003, docs[1][1]), (6003, near(2)), (6004, alone[2] + " end")]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("k, share", [(3, (85, 100)), (5, (80, 100))])
def test_against_brute_force(spark, monkeypatch, k, share):
    monkeypatch.setattr(near_dup, "WIDE", 16)
    monkeypatch.setattr(near_dup, "BLOCK", 8)  # so that regions are taken apart and the exact rest has work
    docs = made(k, 90)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    expected = brute(docs, k, share)
    assert got(near_dup.near_duplicates(df, k, share)) == expected
    kept = near_dup.drop_duplicates(df.selectExpr("*", "doc_id AS node", "1 AS n", "2 AS block"), k, share)
    assert kept.columns == ["doc_id", "text", "node", "n", "block"]
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r[0]) for r in expected if r[3])


def test_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (1, b), (4, "a " * 9)]
    expected = brute(docs, 3, (85, 100))
    assert [r[2] for r in expected] == [1, 1, 1, 1, 1, 4]
    assert got(near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), 3, (85, 100))) == expected


def test_empty_table(spark):
    assert got(near_dup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string"))) == []


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got(QUERIES["op4_near_dup"](spark, folder)) == brute(docs, 3, (85, 100))
