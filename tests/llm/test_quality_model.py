import numpy as np
import pytest
from pyspark.sql import functions as F

from demandgauge.llm import quality_model as M
from demandgauge.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def shrunk(sites):
    """(s, n, above) of all sites -> posterior means, in plain Python."""
    n = sum(x[1] for x in sites)
    even = [max(a * (1 - a), 1e-6) for _, _, a in sites]
    per_row = sum(x[1] * e for x, e in zip(sites, even, strict=True)) / n
    found = sum((s - m * a) ** 2 / m for s, m, a in sites)
    rho = (found - len(sites) * per_row) / max(per_row * (n - len(sites)), 1e-9)
    k = 1 / min(max(rho, 1e-3), 0.9) - 1
    return [(s + k * a) / (m + k) for s, m, a in sites]


def test_site_posteriors_against_plain_python(spark):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(600):
        host, path = (f"h{rng.integers(6)}" if i % 7 else None), f"p{rng.integers(3)}"
        docs.append((i, "text", host, path))
        if i % 3 == 0:
            labels.append((i, int(rng.random() < (0.9 if host == "h1" else 0.4)), int(rng.random() < 0.2)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string, host string, path string")
    hosts, paths, everywhere = M.site_posteriors(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), "host", "path")
    where = {i: (h, p) for i, _, h, p in docs}
    for t, column in (("quality", 1), ("toxic", 2)):
        rate = (sum(x[column] for x in labels) + 1) / (len(labels) + 2)
        assert everywhere.head()[t] == pytest.approx(rate)
        by_host, by_path = {}, {}
        for x in labels:
            for key, into in ((where[x[0]][0], by_host), (where[x[0]], by_path)):
                s, n = into.get(key, (0, 0))
                into[key] = (s + x[column], n + 1)
        host_mean = dict(zip(by_host, shrunk([(*v, rate) for v in by_host.values()]), strict=True))
        path_mean = dict(zip(by_path, shrunk([(*v, host_mean[k[0]]) for k, v in by_path.items()]), strict=True))
        assert {r.host: r[f"{t}_mean"] for r in hosts.collect()} == pytest.approx(host_mean)
        assert {(r.host, r.path): r[f"{t}_mean"] for r in paths.collect()} == pytest.approx(path_mean)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = labels.filter("doc_id % 2 = 0")
    out = M.judge(docs.join(labels.filter("doc_id % 2 = 1").select("doc_id"), "doc_id"), half, models=M.train(docs, half)).join(labels, "doc_id")
    right = out.select(F.avg(((F.col("p_quality") >= 0.5) == (F.col("quality") == 1)).cast("double")), F.avg(((F.col("p_toxic") > 0.5) == (F.col("toxic") == 1)).cast("double"))).head()
    assert right[0] > 0.97 and right[1] > 0.95


def test_edge_rows(spark):
    docs = [(1, None, None, None), (2, "", "a", "b"), (3, "you idiot " * 30, "a", "b"), (None, "plain words", "a", None), (3, "you idiot " * 30, "a", "b"), (4, "word " * 50_000, "z", "z")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string").repartition(3).selectExpr("*", "1 AS host", "2 AS path", "3 AS kept", "4 AS quality")
    labels = spark.createDataFrame([(3, 0, 1), (3, 1, 0), (2, None, 1), (None, 1, 1), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = M.judge(d, labels)
    rows = out.collect()
    assert len(rows) == len(docs) and out.columns == ["doc_id", "text", "source", "lang", "host", "path", "quality", "p_quality", "p_toxic", "kept"]
    assert all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 for r in rows)
    assert len({(r.p_quality, r.p_toxic) for r in rows if r.doc_id == 3}) == 1
    assert {r.kept for r in M.judge(d, labels.limit(0)).collect()} == {True}
    assert M.judge(d.limit(0), labels).collect() == []


def test_query(spark):
    rows = QUERIES["op1_quality_model"](spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    judged = {r.doc_id: r for r in rows}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    clean = [x for x in labels if x.quality == 1 and x.toxic == 0]
    assert sum(judged[x.doc_id].kept for x in clean) / len(clean) > 0.98
