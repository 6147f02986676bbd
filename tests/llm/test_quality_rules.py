import math
import random
import re
from collections import Counter

from demandgauge.llm import quality_rules as Q
from demandgauge.llm.queries import QUERIES


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if seen[(w[i], w[i + 1], w[i + 2])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return counts, len(w) < 50 or 100 * len(covered) > 50 * len(w)


def texts():
    rnd = random.Random(6)
    out = [None, "", " ", "\n \n\t\n", "a", "a b c", "a b c a b c", "x x x x", "é\u00a0é é", "#*$%&|<>", "\x0b\x0c\r word", "line\nline\nline \n line", "A\na", "\u2003 wide"]
    out += ["".join(rnd.choice(["a", "b", "c", " ", " ", "\n", "\t", "é", "#", "|", "\r"]) for _ in range(rnd.randrange(1, 120))) for _ in range(300)]
    return [*out, "one two three " * 20_000, " ".join(f"w{i}" for i in range(60_000))]


def test_counts_against_brute_force(spark):
    rows = [*enumerate(texts()), (3, texts()[3]), (None, texts()[6])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).selectExpr(
        "*", "'en' AS lang", "CAST(null AS string) AS source", "7 AS kept", "8 AS n_words", "9 AS limit_word_length")
    out = Q.judge(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "limit_word_length", *Q.COUNTS, "base_failed", "kept"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (tuple(r[c] for c in Q.COUNTS), r.base_failed) == brute(r.text), r.text[:80]
        assert not (r.base_failed and r.kept)
    assert Q.judge(df.limit(0)).collect() == []


def test_limits_follow_the_group(spark):
    """A rate that is usual in one language is out of range in another; small groups use the level above."""
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    say = lambda marks: " ".join(word() + ("#" if rnd.random() < marks else "") for _ in range(80))
    rows = [(i, say(0.25 + 0.1 * rnd.random()), "code", "a") for i in range(400)] + [(1000 + i, say(0.01), "en", "a") for i in range(900)]
    rows += [(5000, say(0.5), "en", "a"), (5001, say(0.5), "code", "a"), (5002, say(0.01), "rare", "z"), (5003, say(3), None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in Q.judge(df).collect()}
    assert [kept[i] for i in (5000, 5001, 5002)] == [False, True, True]
    assert sum(not kept[i] for i in range(400)) == 0 and sum(not kept[1000 + i] for i in range(900)) == 0


def test_junk_source_with_a_third_of_all_rows(spark):
    """A hot source raises neither its own limit nor those of small groups."""
    plain = " ".join(f"word{i}" for i in range(80))
    say = lambda marks: plain + " " + " ".join(["##"] * marks)
    rows = [(i, say(80), "en", "hot") for i in range(500)] + [(1000 + i, plain, "en", f"s{i % 4}") for i in range(1000)]
    rows += [(5000, say(80), "en", "new"), (5001, plain, "en", "new"), (5002, say(80), "xx", "new"), (5003, plain, "xx", "new")]
    kept = {r.doc_id: r.kept for r in Q.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not any(kept[i] for i in range(500)) and all(kept[1000 + i] for i in range(1000))
    assert [kept[i] for i in (5000, 5001, 5002, 5003)] == [False, True, False, True]


def exact_quantile(values, q):
    return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]


def weighted_median(pairs):
    line = sorted(v for v, weight in pairs for _ in range(weight))
    middle = (len(line) - 1) / 2
    return (line[math.floor(middle)] + line[math.ceil(middle)]) / 2


def brute_limits(rows, rate, least):
    """(lang, source) -> limit of one rate, from all values."""
    def level(values):
        low, high = exact_quantile(values, 0.25), exact_quantile(values, 0.75)
        return high + Q.WIDTH * max(high - low, least)

    def vote(chosen):
        groups = {}
        for r in chosen:
            groups.setdefault(r[1], []).append(rate(r[2]))
        return weighted_median([(round(level(v) * 1000) / 1000, max(1, int(1000 * len(v) / (len(v) + Q.PRIOR)))) for v in groups.values()])

    def mix(own, n, above):
        return (n * min(own, Q.SLACK * above) + Q.PRIOR * above) / (n + Q.PRIOR)

    every, out = vote(rows), {}
    for lang, source in {(r[0], r[1]) for r in rows}:
        of_lang = [r for r in rows if r[0] == lang]
        own = [rate(r[2]) for r in of_lang if r[1] == source]
        out[lang, source] = mix(level(own), len(own), mix(vote(of_lang), len(of_lang), every))
    return out


def test_limits_and_verdicts_against_brute_force(spark):
    """Fewer rows than a sketch holds, so its quantiles are exact: limits, verdicts and the report are recomputed."""
    rnd = random.Random(3)
    rows = []
    for i in range(190):
        lang, source = rnd.choice(["en", "en", "de", None]), rnd.choice(["a", "a", "b", "c", None])
        marks = rnd.random() * (0.9 if source == "c" else 0.2) + (3 if rnd.random() < 0.05 else 0)
        words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(3, 9))) + "#" * int(rnd.random() < marks) * rnd.randrange(1, 4) for _ in range(rnd.randrange(40, 90))]
        rows.append((lang, source, " ".join(words), i))
    df = spark.createDataFrame(rows, "lang string, source string, text string, doc_id bigint").repartition(3)
    counted = Q.counts(df)
    got = {(r.lang, r.source): r for r in Q.thresholds(counted).collect()}
    rates = {
        "symbols_per_word": lambda t: brute(t)[0][2] / max(1, brute(t)[0][0]),
        "word_length": lambda t: brute(t)[0][1] / max(1, brute(t)[0][0]),
        "short_words": lambda t: max(1, brute(t)[0][0]) / max(1, brute(t)[0][1]) * 10,
        "repeat_word_share": lambda t: brute(t)[0][4] / max(1, brute(t)[0][0]),
        "dup_line_share": lambda t: brute(t)[0][3] / max(1, len([x for x in t.split("\n") if x.strip()])),
    }
    limits = {n: brute_limits(rows, rate, Q.LEAST[n]) for n, rate in rates.items()}
    for n, expected in limits.items():
        assert expected.keys() == got.keys()
        for key, value in expected.items():
            assert abs(got[key][f"limit_{n}"] - value) < 1e-9, (n, key)
    judged = {r.doc_id: (r.base_failed, r.kept) for r in Q.judge(df).collect()}
    rejected = Counter()
    for lang, source, text, doc_id in rows:
        over = [n for n, rate in rates.items() if rate(text) > limits[n][lang, source]]
        failed = brute(text)[1]
        assert judged[doc_id] == (failed, not failed and not over)
        rejected.update((lang, source, n) for n in over if not failed)
    assert sum(rejected.values()) > 0 and any(f for f, _ in judged.values())
    for r in Q.rejections(df).collect():
        assert all(r[n] == rejected[r.lang, r.source, n] for n in rates)


def test_one_row_more_changes_limits_little(spark):
    """No row count is a switch: a group of 199 rows and one of 200 have nearly the same limits."""
    say = lambda i: " ".join(f"w{i}x{j}" + "#" * (j % 7 == i % 7) for j in range(60))
    found = []
    for size in (199, 200, 201):
        rows = [(say(i), "en", "a") for i in range(size)] + [(say(i).replace("#", ""), "en", f"s{i % 3}") for i in range(300)]
        df = spark.createDataFrame(rows, "text string, lang string, source string")
        found.append({r.source: r.limit_symbols_per_word for r in Q.thresholds(Q.counts(df)).collect()})
    for source in found[0]:
        assert max(f[source] for f in found) - min(f[source] for f in found) < 0.01


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op6_quality_rules"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (tuple(r[c] for c in Q.COUNTS), r.base_failed) == brute(docs[r.doc_id])
        if labels.get(r.doc_id) == 1 and not r.base_failed:
            assert r.kept
