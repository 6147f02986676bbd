import random
import re

from demandgauge.llm import decontaminate
from demandgauge.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i:i + 13]), set()).add(str(item) if item is not None else None)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (here := windows.get(tuple(w[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= here
        found.discard(None)
        out.append((doc, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    say = lambda n, vocab: " ".join(rnd.choice(vocab) for _ in range(n))
    vocab = ["Alpha", "beta", "é", "straße", "x1", "de", "la"]
    items = [(i, say(rnd.choice([1, 5, 9, 12, 13, 14, 30, 60]), vocab if i % 3 else [f"w{j}" for j in range(200)])) for i in range(30)]
    items += [(98, None), (97, ""), (96, "?!"), (3, items[3][1]), (None, items[9][1])]
    docs = []
    for i in range(120):
        parts = [say(rnd.randrange(0, 40), vocab if rnd.random() < 0.3 else [f"v{j}" for j in range(300)])]
        for _ in range(rnd.randrange(0, 4)):
            w = words(rnd.choice(items)[1])
            a = rnd.randrange(0, len(w) + 1)
            parts += [" ".join(w[a:a + rnd.randrange(0, 40)]).upper(), say(rnd.randrange(0, 9), ["v1", "v2", "beta"])]
        docs.append((i, ", ".join(parts)))
    docs += [(500, None), (501, ""), (502, "... !"), (7, docs[7][1]), (None, docs[8][1]), (503, " ".join(docs[j][1] for j in range(100)) * 3)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute(docs, items)
    assert got(decontaminate.contamination(d, b)) == expected
    clean = decontaminate.drop_contaminated(d.selectExpr("*", "1 AS h", "2 AS n"), b)
    assert clean.columns == ["doc_id", "text", "h", "n"]
    assert clean.count() == sum(not r[-1] for r in expected)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert got(decontaminate.contamination(d, none)) == [(1, 3, 0, "", False)]
    assert got(decontaminate.contamination(d.limit(0), none)) == []


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = QUERIES["op10_decontaminate"](spark, folder).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in rows) == sorted((r[0], r[1], r[2], r[4]) for r in brute(docs, items))
