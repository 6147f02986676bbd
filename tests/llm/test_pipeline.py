import re

import corpus_pipeline as P
from tests.llm import test_bpe, test_decontaminate, test_near_dup
from tests.llm.test_near_dup import shingles

FOLDER = "/root/testdata/sf0.001"


def base_failed(text):
    from collections import Counter
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if seen[(w[i], w[i + 1], w[i + 2])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    columns, lib = docs.columns, test_bpe.library()
    for i, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if i < len(P.STAGES) - 1:
            assert docs.columns == columns
        gone = set(before) - set(after)
        if name == "quality_rules":
            assert gone >= {d for d, r in before.items() if base_failed(r.text)}
            good = [d for d, r in before.items() if labels.get(d) == 1 and not base_failed(r.text)]
            assert len(set(good) & gone) <= 0.01 * len(good)
        elif name == "near_dup":
            expected = test_near_dup.brute([(d, r.text) for d, r in before.items()], 5, (80, 100))
            assert set(after) == {d for d, _, _, kept in expected if kept}
            assert all(shingles(r.text, 5) for r in after.values())
        elif name == "decontaminate":
            assert gone == {r[0] for r in test_decontaminate.brute([(d, r.text) for d, r in before.items()], items) if r[4]}
        elif name == "secrets":
            assert not gone
            secret = re.compile(r'(?i)(token = ")[0-9a-f]{40}(?=")')
            for d, r in after.items():
                assert r.text == secret.sub(lambda m: m[1] + "[SECRET]", before[d].text) and r.n_chars == len(r.text)
        else:
            assert not gone and all(r.ids == lib.encode_ordinary(r.text) and r.n_tokens == len(r.ids) for r in after.values())


def test_run(spark):
    out = P.run(spark, FOLDER)
    assert out.count() > 0 and {"doc_id", "text", "ids", "n_tokens"} <= set(out.columns)
