import json
import math
import random

import pytest
from pyspark.sql import functions as F

from demandgauge import constants as K
from demandgauge.operators import quality as G, review as R, spatial
from demandgauge.plans.quality_run import judge_points
from demandgauge.sources import tables


def at(day):
    return F.lit(day).cast("timestamp")



def metres(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("levels", [1, 4])
def test_nearest_equals_brute_force(spark, levels):
    rng = random.Random(5)
    town = [(round(56 + rng.gauss(0, 0.01), 4), round(-3 + rng.gauss(0, 0.02), 4)) for _ in range(150)]
    refs = [(f"P{i:03d}", *p) for i, p in enumerate(town)]
    refs += [(f"Q{i}", 56 + rng.uniform(-.5, .5), -3 + rng.uniform(-.9, .9)) for i in range(60)]
    refs += [("W1", 10.0, 179.999), ("W0", 10.0, 179.999)]
    points = [(i, 56 + rng.gauss(0, 0.05), -3 + rng.gauss(0, 0.1)) for i in range(250)]
    points += [(900, None, 1.0), (901, 10.0, -179.999), (902, *town[0]), (903, *town[0])]
    got = spatial.nearest_join(
        spark.createDataFrame(points, "id int, latitude double, longitude double"),
        spark.createDataFrame(refs, "postcode string, latitude double, longitude double"), 2000.0, levels)
    seen = {r.id: r.nearest_postcode for r in got.collect()}
    for i, lat, lon in points:
        best = None
        if lat is not None:
            near = min((round(metres((lat, lon), r[1:]), 6), r[0]) for r in refs)
            best = near[1] if near[0] <= 2000 else None
        assert seen[i] == best
    assert seen[901] == "W0" and len(seen) == len(points)


def test_verdicts(spark):
    cps = spark.sql("""SELECT * FROM VALUES
        ('ok', 'EH1 1AA', 'EH2'), ('abroad', 'M1', null), ('none', null, 'EH1'), ('digits', '12', 'EH1'),
        ('differs', ' eh1', 'G1 1AA'), ('border', 'EH1', 'M1'), ('lost', 'EH1', null)
        v(cp_id, postcode, coord_postcode)""")
    judged = G.with_verdict(G.with_areas(cps), tables.postcode_areas(spark))
    got = {r.cp_id: r.verdict for r in judged.collect()}
    assert got == {"ok": None, "abroad": "postcode_not_scottish", "none": "postcode_missing",
                   "digits": "postcode_missing", "differs": "area_mismatch", "border": None, "lost": None}
    assert {r.verdict: r.points for r in G.verdict_counts(judged).collect()}[None] == 3


def test_empty_allowlist_raises(spark):
    none = tables.postcode_areas(spark).limit(0)
    with pytest.raises(ValueError, match="empty"):
        judge_points(None, None, none)


def test_findings_text(spark):
    points = spark.createDataFrame(
        [("1", "O'Neil", "M11", "M", None, None, "postcode_not_scottish"), ("2", None, None, None, "G1", "G", "postcode_missing")],
        "cp_id string, site_name string, postcode string, feed_area string, coord_postcode string, coord_area string, verdict string")
    one, two = G.build_findings(points).orderBy("entity_id").collect()
    assert one.message == "Feed postcode 'M11' (area 'M') — not a Scottish postcode area."
    assert two.message == "Feed postcode None (area None) — no postcode on record."
    assert json.loads(one.details) == {"verdict": "postcode_not_scottish", "site_name": "O'Neil", "feed_postcode": "M11",
                                       "feed_area": "M", "coord_postcode": None, "coord_area": None}
    odd = spark.createDataFrame([("it's",), ('a"b',), ("a'b\"c",), ("a\\b",), (None,)], "v string")
    assert [r.q for r in odd.select(G.quoted(F.col("v")).alias("q")).collect()] == [
        repr("it's"), repr('a"b'), repr("a'b\"c"), repr("a\\b"), "None"]


def test_register_state_machine(spark):
    cn = K.POSTCODE_CHECK
    old = "2025-01-01"
    rows = [(cn, f"{state}_{hit}", "old", "{}", state, old, None if state == "open" else old)
            for state in ("open", "resolved", "dismissed") for hit in ("hit", "gone")]
    rows.append(("other", "open_gone", "old", "{}", "open", old, None))
    register = spark.createDataFrame(
        rows, "check_name string, entity_id string, message string, details string, status string, detected_at string, resolved_at string"
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("detected_at", "resolved_at")})
    hits = spark.createDataFrame([(e, "new", '{"a":1}') for e in ("open_hit", "resolved_hit", "dismissed_hit", "fresh")],
                                 "entity_id string, message string, details string")
    first = G.merge_findings(register, hits, at("2026-01-01"))
    got = {(r.check_name, r.entity_id): (r.message, r.status, str(r.detected_at)[:4], r.resolved_at and str(r.resolved_at)[:4])
           for r in first.collect()}
    assert got == {
        (cn, "open_hit"): ("old", "open", "2025", None), (cn, "open_gone"): ("old", "resolved", "2025", "2026"),
        (cn, "resolved_hit"): ("new", "open", "2025", None), (cn, "resolved_gone"): ("old", "resolved", "2025", "2025"),
        (cn, "dismissed_hit"): ("old", "dismissed", "2025", "2025"),
        (cn, "dismissed_gone"): ("old", "dismissed", "2025", "2025"),
        (cn, "fresh"): ("new", "open", "2026", None), ("other", "open_gone"): ("old", "open", "2025", None),
    }
    later = at("2027-01-01")
    again = G.merge_findings(first, hits, later)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, first.collect()), key=str)
    out = G.dismiss(first, spark.createDataFrame([("fresh",), ("open_gone",)], "entity_id string"), later)
    states = {(r.check_name, r.entity_id): r.status for r in out.collect()}
    assert states[cn, "fresh"] == "dismissed" and states["other", "open_gone"] == "open" and out.count() == 8


def test_review_cycle(spark):
    cn = K.POSTCODE_CHECK
    base = {"verdict": "area_mismatch", "site_name": "Hall", "feed_postcode": "EH1", "coord_postcode": "G1", "extra": {"n": 1.5}}
    rows = [(cn, "1", json.dumps(base)), (cn, "2", json.dumps(base)), (cn, "3", json.dumps({"ai_reviewed": True})),
            (cn, "4", json.dumps({"verdict": "postcode_missing"}))]
    register = spark.createDataFrame(rows, "check_name string, entity_id string, details string").select(
        "check_name", "entity_id", F.lit("m").alias("message"), "details", F.lit("open").alias("status"),
        at("2026-01-01").alias("detected_at"), F.lit(None).cast("timestamp").alias("resolved_at"))
    cps = spark.createDataFrame([("1", "1", 56.0, -3.0), ("2", "1", 56.0, -3.0), ("4", "1", None, None)],
                                "cp_id string, connector_id string, latitude double, longitude double")
    asked = R.with_question(R.pending_review(register, cps))
    assert {r.cp_id for r in asked.collect()} == {"1", "2", "4"}
    questions = R.distinct_questions(asked).orderBy("question").collect()
    assert len(questions) == 2 and "nan, nan" in questions[1].question + questions[0].question
    hall = next(q for q in questions if "Hall" in q.question)
    other = next(q for q in questions if "Hall" not in q.question)
    text = 'It is {"issue": "x", "correct_postcode": "g2 3ab", "postcode_wrong": true, "coords_wrong": 1, "site_name": "New"} ok'
    answers = R.extract_json(spark.createDataFrame(
        [(hall.question_id, text, "r1"), (other.question_id, "no idea {", "r2")],
        "question_id string, text string, request_id string"))
    centroids = spark.createDataFrame([("G2 3AB", 55.5, -4.5)], "postcode string, latitude double, longitude double")
    merged = R.merge_suggestions(asked, answers, centroids, "model-x")
    got = {r.cp_id: json.loads(r.details) for r in merged.collect()}
    assert set(got) == {"1", "2"}
    assert got["1"] == {**base, "issue": "x", "description": None, "correct_postcode": "g2 3ab", "postcode_wrong": True,
                        "coords_wrong": True, "ai_model": "model-x", "request_id": "r1", "ai_reviewed": True,
                        "suggested_postcode": "g2 3ab", "suggested_latitude": 55.5, "suggested_longitude": -4.5}
    updated = R.apply_suggestions(register, merged)
    assert R.pending_review(updated, cps).count() == 1
    queue = R.review_queue(updated).collect()
    assert [r.verdict for r in queue] == [None, "area_mismatch", "area_mismatch", "postcode_missing"]
    assert queue[1].suggested_postcode == "g2 3ab" and queue[1].suggested_address is None
