"""Ranked search against scores of all documents, computed in plain Python."""

import math
import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from demandgauge.llm import ranked_search as R
from demandgauge.llm.queries import ORACLE, op11_ranked_search

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=20):
    """[(item, rank, doc_id, score)]"""
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, length = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    out = []
    for item, text in items:
        scored = []
        for i, own in terms:
            if own:
                tf, m = Counter(own), 75 + (25 * len(own) * n_docs) // length
                score = sum(
                    math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m))
                    for w in TERM.findall((text or "").translate(LOWER)) if w in tf)
                if score > 0:
                    scored.append((-score, i is not None, i, ))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, k=20, postings=R.POSTINGS, query_words=R.QUERY_WORDS, parts=3):
    documents = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).withColumns({"id": F.lit(1), "rank": F.lit("x")})
    asked = spark.createDataFrame(items, "item_id string, text string").withColumn("terms", F.lit(0))
    index = R.build_index(documents, postings=postings)
    return sorted((tuple(r) for r in R.search(index, asked, k, query_words=query_words).collect()), key=str)


def made(rng, n, words=60, longest=40):
    vocabulary = [f"w{i}" for i in range(words)] + ["Été", "ÉTÉ", "x1", "I", "中文"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize(("postings", "k", "query_words"), [(1 << 20, 20, 1 << 20), (50, 3, 40), (1, 7, 10)])
def test_equals_all_scores(spark, monkeypatch, postings, k, query_words):
    rng = random.Random(postings)
    texts = made(rng, 300)
    docs = [(i * 3 % 299, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "--- !"), (1003, "w1 " * 500)]
    docs = list({i: (i, t) for i, t in docs}.values())
    items = [(f"q{i}", t) for i, t in enumerate(made(rng, 25, longest=25))] + [("none", None), ("new", "unheard of"), ("same", "w0 w0 w0")]
    assert ranked(spark, docs, items, k, postings, query_words) == plain(docs, items, k)


def test_ties_by_id_and_repeated_rows(spark):
    docs = [(i, "one two") for i in range(60, 0, -1)] + [(None, "one two"), (7, "one two"), (99, "three")]
    got = ranked(spark, docs, [("q", "two"), ("q", "two")], k=10, postings=7)
    assert [d for _, _, d, _ in got if True].count(7) == 4 and len(got) == 20
    assert sorted({(r, d) for _, r, d, _ in got if r <= 2}, key=str) == [(1, None), (2, 1)]


def test_empty_tables(spark):
    assert ranked(spark, [], [("q", "a")]) == []
    assert ranked(spark, [(1, None)], [("q", "a")]) == []
    assert ranked(spark, [(1, "a")], []) == []


def test_tree_holds_every_point():
    rng = np.random.Generator(np.random.PCG64(2))
    for n_rows, n_columns, n in ((1, 1, 1), (1, 300, 90), (500, 2, 400), (64, 64, 900), (3000, 700, 5000)):
        flat = np.unique(rng.integers(0, n_rows * n_columns, n))
        rows, columns, impacts = flat // n_columns, flat % n_columns, rng.integers(0, 1 << 20, len(flat))
        tree = R.build_tree(rows, columns, impacts)
        leaves = tree["masks"] == 0
        got = set(zip(tree["leaf_rows"].tolist(), tree["leaf_columns"].tolist(), tree["peaks"][leaves].tolist(), strict=True))
        assert got == set(zip(rows.tolist(), columns.tolist(), impacts.tolist(), strict=True))
        ones = R._ONES[tree["masks"]].astype(int)
        child = 1 + np.cumsum(ones) - ones
        for node in np.flatnonzero(~leaves)[:200]:
            assert tree["peaks"][node] == tree["peaks"][child[node]:child[node] + ones[node]].max()


def test_search_leaves_most_cells_unopened():
    """Ranges below the k-th score are never halved."""
    rng = np.random.Generator(np.random.PCG64(3))
    columns = np.arange(20_000)
    impacts = rng.permutation(20_000) + 1
    row = R.build_tree(np.zeros(20_000, dtype=np.int64), columns, impacts)
    tree = R.Tree({"columns": columns.tobytes(), "terms": np.array([5], np.uint64).tobytes(), "rows": np.zeros(1, np.uint32).tobytes(),
                   "held": np.array([20_000], np.uint32).tobytes(), "height": row["height"],
                   **{c: row[c].astype(R._TYPES[c]).tobytes() for c in ("masks", "peaks", "leaf_rows", "leaf_columns")}})
    opened, halved = [], tree._halved
    tree._halved = lambda ranges, *x: (opened.append(len(ranges[0])), halved(ranges, *x))[1]
    scores, ids = tree.best(np.array([0]), np.array([2]), 5, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert scores.tolist() == [2 * x for x in range(20_000, 19_995, -1)] and (impacts[ids] * 2 == scores).all()
    assert sum(opened) < 4000


def test_query(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    got = op11_ranked_search(spark, FOLDER)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLE["op11_ranked_search"]).fetchall())


def test_blocks_are_written_one_by_one(spark):
    """A reader of a large block need not hold the next one."""
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(1200))) for i in range(600)]
    index = R.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), postings=150_000)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert len(groups) >= 3 and set(groups) == {1}


def test_workers_get_one_block_and_few_texts_at_a_time(spark, monkeypatch):
    name, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before = spark.conf.get(name)
    write_once = R.write_once
    monkeypatch.setattr(R, "write_once", lambda df, label, *x, **y: rows.update({label: int(spark.conf.get(name))}) or write_once(df, label, *x, **y))
    docs = [(i, f"w{i % 7} all") for i in range(50)]
    assert len(ranked(spark, docs, [("q", "w1 w2")], postings=3)) == 14
    assert rows["treaps"] <= 1000 and rows["near"] == 1
    assert spark.conf.get(name) == before


def test_failing_work_leaves_rows_of_a_batch_as_set(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), R.arrow_rows(spark, 3):
        assert spark.conf.get(name) == "3"
        spark.range(10).count() / 0
    assert spark.conf.get(name) == before


def test_memory_of_a_block():
    """Bytes for each point, beside the block's own: while its tree is made, and of the tree when searched."""
    rng = np.random.Generator(np.random.PCG64(5))
    block = R._Block(500, 500 * 600)
    texts = pa.array([" ".join(f"w{x}" for x in rng.zipf(1.3, 600) % 10**6) for _ in range(500)])
    block.add(np.arange(500), texts)
    points = block.n_points
    tracemalloc.start()
    try:
        row = block.finish()
        assert tracemalloc.get_traced_memory()[1] < 90 * points
        columns = {name: R._unpacked(pa.py_buffer(row[name]), name) for name in R._TYPES}
        tracemalloc.reset_peak()
        was = tracemalloc.get_traced_memory()[0]
        tree = R.Tree(columns | {"height": row["height"]})
        assert len(tree.masks) and tracemalloc.get_traced_memory()[0] - was < 20 * points
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("name", ["columns", "rows", "masks"])
def test_packed_columns_come_back(name):
    kind = np.dtype(R._TYPES[name])
    for x in (np.arange(1000), np.zeros(1), np.array([np.iinfo(kind).min, np.iinfo(kind).max])):
        back = R._unpacked(pa.py_buffer(R._packed(x.astype(kind), name)), name)
        assert back.dtype == kind and back.tolist() == x.astype(kind).tolist()
