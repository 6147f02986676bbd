"""Queries on postcode checks, the findings register and its review."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandgauge import constants as K
from demandgauge.operators import quality as G, review as R, spatial
from demandgauge.operators.pressure import cp_reference
from demandgauge.plans.quality_run import judge_points
from demandgauge.session import materialise
from demandgauge.sources.tables import require_nonempty

from . import inputs as I

NOW = "2026-01-01 00:00:00"
CHECK = K.POSTCODE_CHECK


def _at_customer(lat_step: int, lon_step: int):
    k = F.col("c_custkey")
    return (F.lit(54.9) + (k * lat_step % 1500).cast("double") / 1000,
            F.lit(-4.1) + (k * lon_step % 900).cast("double") / 1000)


def references(spark, d) -> DataFrame:
    """Customers as postcode centroids."""
    k = F.col("c_custkey")
    area = F.element_at(F.array(*[F.lit(a) for a in I.AREA_CODES]), (k % 17 + 1).cast("int"))
    lat, lon = _at_customer(37, 91)
    return I.table(spark, d, "customer").select(
        F.concat(area, (k % 9 + 1).cast("string"), F.lit(" "), F.lpad(k.cast("string"), 6, "0")).alias("postcode"),
        lat.alias("latitude"), lon.alias("longitude"))


REFERENCES_SQL = f"""
refs AS (
  SELECT {I.AREA_LIST_SQL}[CAST(c_custkey % 17 + 1 AS INTEGER)] || (c_custkey % 9 + 1) || ' '
           || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS pc,
         54.9::DOUBLE + (c_custkey * 37 % 1500)::DOUBLE / 1000 AS rlat,
         (-4.1)::DOUBLE + (c_custkey * 91 % 900)::DOUBLE / 1000 AS rlon
  FROM customer
)"""
_DIST = """2 * 6371008.8::DOUBLE * asin(least(sqrt(
  sin(radians({b}lat - {a}lat) / 2) * sin(radians({b}lat - {a}lat) / 2)
  + cos(radians({a}lat)) * cos(radians({b}lat)) * sin(radians({b}lon - {a}lon) / 2) * sin(radians({b}lon - {a}lon) / 2)), 1.0))"""
JUDGED_SQL = f"""
places AS (SELECT cp_id, site_name, postcode, latitude AS plat, longitude AS plon FROM cp_ref),
nearest AS (
  SELECT cp_id, arg_min(pc, (dist, pc)) AS coord_postcode, min(dist) AS dist FROM (
    SELECT cp_id, pc, {_DIST.format(a='p', b='r')} AS dist FROM places, refs
    WHERE plat IS NOT NULL AND plon IS NOT NULL AND abs(plat - rlat) < 0.02) WHERE dist <= 2000 GROUP BY cp_id
),
areas AS (
  SELECT places.*, coord_postcode, dist,
         nullif(regexp_extract(upper(trim(postcode)), '^([A-Z]{{1,2}})', 1), '') AS feed_area,
         nullif(regexp_extract(upper(trim(coord_postcode)), '^([A-Z]{{1,2}})', 1), '') AS coord_area
  FROM places LEFT JOIN nearest USING (cp_id)
),
judged AS (
  SELECT *, CASE WHEN feed_area IS NULL THEN 'postcode_missing'
                 WHEN feed_area NOT IN ({", ".join(f"'{a}'" for a in K.POSTCODE_AREAS)}) THEN 'postcode_not_scottish'
                 WHEN coord_area IN ({", ".join(f"'{a}'" for a in K.POSTCODE_AREAS)}) AND coord_area <> feed_area
                   THEN 'area_mismatch' END AS verdict
  FROM areas
),
flagged AS (SELECT * FROM judged WHERE verdict IS NOT NULL)"""
_WITH = f"WITH {I.CONNECTORS_SQL}, {REFERENCES_SQL}, {JUDGED_SQL}"


def allowlist(spark, d) -> DataFrame:
    """The allowlist as a table, derived from the references: every area but ``M``."""
    return require_nonempty(
        references(spark, d).select(F.regexp_extract("postcode", "^([A-Z]{1,2})", 1).alias("area_code"))
        .where("area_code <> 'M'").distinct(), "allowlist")


def judged(spark, d) -> DataFrame:
    return judge_points(I.connectors(spark, d), references(spark, d), allowlist(spark, d))


def nearest_postcode(spark, d):
    placed = spatial.nearest_join(cp_reference(I.connectors(spark, d)), references(spark, d))
    return placed.select("cp_id", "nearest_postcode", F.round("distance_m", 3).alias("distance_m"))


def _spread_points(spark, d) -> DataFrame:
    lat, lon = _at_customer(113, 71)
    k = F.col("c_custkey")
    return I.table(spark, d, "customer").select(
        "c_custkey", F.when(k % 31 != 0, lat + (k % 7).cast("double") / 1000).alias("latitude"), lon.alias("longitude"))


def nearest_levels(spark, d):
    """Many points, searched on all grids."""
    placed = spatial.nearest_join(_spread_points(spark, d), references(spark, d), 3000.0, levels=4)
    return placed.select("c_custkey", "nearest_postcode", F.round("distance_m", 3).alias("distance_m"))


def forward_geocode(spark, d):
    k = F.col("user_id")
    asked = I.connectors(spark, d).where("connector_id = '1'").select(
        "cp_id", F.concat(F.element_at(F.array(*[F.lit(a) for a in I.AREA_CODES]), (k % 17 + 1).cast("int")),
                          (k % 9 + 1).cast("string"), F.when(k % 2 == 0, "  ").otherwise(""),
                          F.lpad(k.cast("string"), 6, "0")).alias("postcode")).withColumn("postcode", F.lower("postcode"))
    return spatial.centroid_join(asked, references(spark, d)).select("cp_id", "centroid_latitude", "centroid_longitude")


def verdicts(spark, d):
    return judged(spark, d).select("cp_id", "feed_area", "coord_area", "verdict")


def verdict_counts(spark, d):
    return G.verdict_counts(judged(spark, d))


_DETAILS = ["verdict", "site_name", "feed_postcode", "feed_area", "coord_postcode", "coord_area"]


def findings(spark, d) -> DataFrame:
    return G.build_findings(G.flagged(judged(spark, d)))


def build_findings(spark, d):
    return findings(spark, d).select(
        "check_name", "entity_id", "message",
        *[R.json_field(F.col("details"), c).alias(c) for c in _DETAILS])


def register(spark, d) -> DataFrame:
    """A register from earlier runs: every state, and rows of another check."""
    u = F.col("user_id")
    points = I.connectors(spark, d).where("connector_id = '1'")
    mine = points.where(u % 4 != 3).select(
        F.lit(CHECK).alias("check_name"), F.col("cp_id").alias("entity_id"), F.lit("old text").alias("message"),
        F.lit('{"verdict": "old", "description": "kept"}').alias("details"),
        F.element_at(F.array(F.lit("open"), F.lit("resolved"), F.lit("dismissed")), (u % 4 + 1).cast("int")).alias("status"),
        F.lit("2025-05-01 00:00:00").cast("timestamp").alias("detected_at"),
        F.when(u % 4 != 0, F.lit("2025-06-01 00:00:00").cast("timestamp")).alias("resolved_at"))
    other = points.where(u % 7 == 0).select(
        F.lit("another.check").alias("check_name"), F.col("cp_id").alias("entity_id"), F.lit("other").alias("message"),
        F.lit("{}").alias("details"), F.lit("open").alias("status"),
        F.lit("2025-05-01 00:00:00").cast("timestamp").alias("detected_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"))
    return mine.unionByName(other)


REGISTER_SQL = f"""
register AS (
  SELECT '{CHECK}' AS check_name, cp_id AS entity_id, 'old text' AS message,
         '{{"verdict": "old", "description": "kept"}}' AS details,
         ['open', 'resolved', 'dismissed'][CAST(user_id % 4 + 1 AS INTEGER)] AS status,
         TIMESTAMP '2025-05-01' AS detected_at, CASE WHEN user_id % 4 <> 0 THEN TIMESTAMP '2025-06-01' END AS resolved_at
  FROM points WHERE user_id % 4 <> 3
  UNION ALL
  SELECT 'another.check', cp_id, 'other', '{{}}', 'open', TIMESTAMP '2025-05-01', NULL FROM points WHERE user_id % 7 = 0
),
fresh AS (
  SELECT cp_id AS entity_id,
         'Feed postcode ' || CASE WHEN postcode IS NULL THEN 'None' ELSE '''' || postcode || '''' END
         || ' (area ' || CASE WHEN feed_area IS NULL THEN 'None' ELSE '''' || feed_area || '''' END || ') — '
         || CASE verdict {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.VERDICT_TEXT.items())} END || '.' AS message,
         verdict, site_name, postcode AS feed_postcode, feed_area, coord_postcode, coord_area
  FROM flagged
),
merged AS (
  SELECT '{CHECK}' AS check_name, coalesce(r.entity_id, f.entity_id) AS entity_id,
         CASE WHEN r.entity_id IS NULL OR (f.entity_id IS NOT NULL AND r.status = 'resolved') THEN f.message ELSE r.message END AS message,
         CASE WHEN r.entity_id IS NULL OR (f.entity_id IS NOT NULL AND r.status = 'resolved') THEN f.verdict ELSE 'old' END AS verdict,
         CASE WHEN r.entity_id IS NULL OR (f.entity_id IS NOT NULL AND r.status = 'resolved') THEN f.coord_postcode END AS coord_postcode,
         CASE WHEN r.entity_id IS NULL OR (f.entity_id IS NOT NULL AND r.status = 'resolved') THEN NULL ELSE 'kept' END AS description,
         CASE WHEN r.entity_id IS NULL OR (f.entity_id IS NOT NULL AND r.status = 'resolved') THEN 'open'
              WHEN r.status = 'open' AND f.entity_id IS NULL THEN 'resolved' ELSE r.status END AS status,
         CASE WHEN r.entity_id IS NULL THEN TIMESTAMP '{NOW}' ELSE r.detected_at END AS detected_at,
         CASE WHEN r.entity_id IS NULL OR (f.entity_id IS NOT NULL AND r.status = 'resolved') THEN NULL
              WHEN r.status = 'open' AND f.entity_id IS NULL THEN TIMESTAMP '{NOW}' ELSE r.resolved_at END AS resolved_at
  FROM (SELECT * FROM register WHERE check_name = '{CHECK}') r FULL JOIN fresh f ON r.entity_id = f.entity_id
  UNION ALL
  SELECT check_name, entity_id, message, NULL, NULL, NULL, status, detected_at, resolved_at
  FROM register WHERE check_name <> '{CHECK}'
)"""
_WITH_REGISTER = f"{_WITH}, {REGISTER_SQL}"


def _now():
    return F.lit(NOW).cast("timestamp")


def merged(spark, d) -> DataFrame:
    """The register after a run, written as a new version."""
    return materialise(G.merge_findings(register(spark, d), findings(spark, d), _now()), "register")


def _stamps(*columns: str):
    return [F.date_format(c, "yyyy-MM-dd").alias(c) for c in columns]


def merge_findings(spark, d):
    return merged(spark, d).select(
        "check_name", "entity_id", "message", "status", *_stamps("detected_at", "resolved_at"),
        *[R.json_field(F.col("details"), c).alias(c) for c in ("verdict", "coord_postcode", "description")])


def merge_findings_again(spark, d):
    """A second run over the same data changes nothing."""
    later = F.lit("2027-01-01 00:00:00").cast("timestamp")
    return G.merge_findings(merged(spark, d), findings(spark, d), later).select(
        "check_name", "entity_id", "message", "status", *_stamps("detected_at", "resolved_at"))


def pending_review(spark, d):
    return R.pending_review(merged(spark, d), I.connectors(spark, d)).select(
        "cp_id", R.json_field(F.col("details"), "verdict").alias("verdict"), "latitude", "longitude")


def asked(spark, d, version: DataFrame | None = None) -> DataFrame:
    stored = merged(spark, d) if version is None else version
    return R.with_question(R.pending_review(stored, I.connectors(spark, d)))


def collapse_questions(spark, d):
    return R.distinct_questions(asked(spark, d)).select("question_id", "question")


def answers(questions: DataFrame) -> DataFrame:
    """Written answers to the questions: JSON inside prose, some empty, some broken."""
    n = F.length("question")
    postcode = F.when(n % 5 != 0, F.regexp_extract("question", "Postcode at the coordinates: ([A-Z0-9 ]+)", 1)).otherwise("")
    body = F.when(n % 11 == 0, F.lit("{broken")).when(n % 13 == 0, F.lit("{}")).otherwise(F.concat(
        F.lit('{"issue": "wrong \\"area\\"", "correct_postcode": "'), postcode,
        F.lit('", "postcode_wrong": '), F.when(n % 2 == 0, "true").otherwise("false"),
        F.lit(', "coords_wrong": '), F.when(n % 3 == 0, "true").otherwise("false"), F.lit(', "description": null}')))
    text = R.distinct_questions(questions).select(
        "question_id", F.concat(F.lit("Sure: "), body, F.lit(" done")).alias("text"),
        F.substring("question_id", 1, 8).alias("request_id"))
    return R.extract_json(text)


_MERGED_FIELDS = ["verdict", "issue", "correct_postcode", "postcode_wrong", "coords_wrong", "request_id", "ai_reviewed",
                  "suggested_postcode", "suggested_latitude", "suggested_longitude"]


def suggestions(spark, d, version: DataFrame | None = None) -> DataFrame:
    questions = materialise(asked(spark, d, version), "questions")
    return R.merge_suggestions(questions, answers(questions), references(spark, d), "assistant-1")


def merge_suggestions(spark, d):
    found = suggestions(spark, d).select(
        "cp_id", *[R.json_field(F.col("details"), c).alias(c) for c in _MERGED_FIELDS])
    return found.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("suggested_latitude", "suggested_longitude")})


def review_queue(spark, d):
    version = merged(spark, d)
    reviewed = R.apply_suggestions(version, suggestions(spark, d, version))
    return R.review_queue(reviewed).select("cp_id", "message", "verdict", "coord_postcode", "suggested_postcode", "description")


def dismiss(spark, d):
    chosen = I.connectors(spark, d).where("user_id % 5 = 0").select(F.col("cp_id").alias("entity_id"))
    return G.dismiss(register(spark, d), chosen, _now()).select(
        "check_name", "entity_id", "status", *_stamps("resolved_at"))


def extract_json(spark, d):
    t = F.col("turn")
    body = F.concat(F.lit('{"conv": '), F.col("conv_id").cast("string"), F.lit(', "turn": {"n": '), t.cast("string"), F.lit("}}"))
    text = F.concat(F.lit("answer:\n"), F.when(t % 4 == 1, F.lit("nothing")).when(t % 4 == 2, F.concat(F.lit("{bad "), body))
                    .otherwise(body), F.lit("\nend "), F.col("text"))
    rows = I.table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))
    return R.extract_json(rows).select(
        "conv_id", "turn", R.json_field(F.col("answer"), "conv").alias("conv"),
        R.json_field(F.col("answer"), "turn.n").alias("n"), F.length("answer").cast("string").alias("length"))


QUERIES = {
    "nearest_postcode": nearest_postcode,
    "nearest_levels": nearest_levels,
    "forward_geocode": forward_geocode,
    "verdicts": verdicts,
    "verdict_counts": verdict_counts,
    "build_findings": build_findings,
    "merge_findings": merge_findings,
    "merge_findings_again": merge_findings_again,
    "pending_review": pending_review,
    "collapse_questions": collapse_questions,
    "extract_json": extract_json,
    "merge_suggestions": merge_suggestions,
    "review_queue": review_queue,
    "dismiss": dismiss,
}

_STAMPS = "strftime(detected_at, '%Y-%m-%d') AS detected_at, strftime(resolved_at, '%Y-%m-%d') AS resolved_at"
PENDING_SQL = _WITH_REGISTER + f""",
pending AS (
  SELECT m.entity_id AS cp_id, m.verdict, m.message,
         CASE WHEN m.description IS NULL THEN f.site_name END AS site_name,
         CASE WHEN m.description IS NULL THEN f.feed_postcode END AS feed_postcode, m.coord_postcode, m.description,
         latitude, longitude
  FROM merged m LEFT JOIN fresh f ON m.entity_id = f.entity_id LEFT JOIN cp_ref c ON m.entity_id = c.cp_id
  WHERE m.check_name = '{CHECK}' AND m.status = 'open'
),
asked AS (
  SELECT *, 'Verdict: ' || coalesce(verdict, 'None') || chr(10) || 'Site: ' || coalesce(site_name, 'None') || chr(10)
            || 'Recorded postcode: ' || coalesce(feed_postcode, 'None') || chr(10)
            || 'Postcode at the coordinates: ' || coalesce(coord_postcode, 'None') || chr(10)
            || 'Coordinates: ' || coalesce(CAST(latitude AS VARCHAR), 'nan') || ', '
            || coalesce(CAST(longitude AS VARCHAR), 'nan') AS question
  FROM pending
),
replies AS (
  SELECT *, length(question) AS n,
         CASE WHEN length(question) % 5 <> 0
              THEN regexp_extract(question, 'Postcode at the coordinates: ([A-Z0-9 ]+)', 1) ELSE '' END AS good
  FROM asked
),
answered AS (
  SELECT r.*, n % 2 = 0 AS pw, n % 3 = 0 AS cw, rlat, rlon
  FROM replies r LEFT JOIN refs ON r.good = refs.pc
  WHERE n % 11 <> 0 AND n % 13 <> 0
)"""

ORACLE = {
    "nearest_postcode": _WITH + """
SELECT cp_id, coord_postcode AS nearest_postcode, round(dist, 3) AS distance_m FROM areas""",
    "nearest_levels": f"""WITH {REFERENCES_SQL},
pts AS (
  SELECT c_custkey, CASE WHEN c_custkey % 31 <> 0 THEN 54.9::DOUBLE + (c_custkey * 113 % 1500)::DOUBLE / 1000
                         + (c_custkey % 7)::DOUBLE / 1000 END AS plat,
         (-4.1)::DOUBLE + (c_custkey * 71 % 900)::DOUBLE / 1000 AS plon FROM customer
),
hits AS (
  SELECT c_custkey, arg_min(pc, (dist, pc)) AS nearest_postcode, min(dist) AS dist FROM (
    SELECT c_custkey, pc, {_DIST.format(a='p', b='r')} AS dist FROM pts, refs WHERE abs(plat - rlat) < 0.03)
  WHERE dist <= 3000 GROUP BY c_custkey
)
SELECT c_custkey, nearest_postcode, round(dist, 3) AS distance_m FROM pts LEFT JOIN hits USING (c_custkey)""",
    "forward_geocode": f"""WITH {I.CONNECTORS_SQL}, {REFERENCES_SQL}
SELECT cp_id, rlat AS centroid_latitude, rlon AS centroid_longitude
FROM points LEFT JOIN refs ON replace(refs.pc, ' ', '') =
  {I.AREA_LIST_SQL}[CAST(user_id % 17 + 1 AS INTEGER)] || (user_id % 9 + 1) || lpad(CAST(user_id AS VARCHAR), 6, '0')""",
    "verdicts": _WITH + " SELECT cp_id, feed_area, coord_area, verdict FROM judged",
    "verdict_counts": _WITH + " SELECT verdict, count(*) AS points FROM judged GROUP BY verdict",
    "build_findings": _WITH_REGISTER + f"""
SELECT '{CHECK}' AS check_name, entity_id, message, {", ".join(_DETAILS)} FROM fresh""",
    "merge_findings": _WITH_REGISTER + f"""
SELECT check_name, entity_id, message, status, {_STAMPS}, verdict, coord_postcode, description FROM merged""",
    "merge_findings_again": _WITH_REGISTER + f"""
SELECT check_name, entity_id, message, status, {_STAMPS} FROM merged""",
    "pending_review": PENDING_SQL + " SELECT cp_id, verdict, latitude, longitude FROM pending",
    "collapse_questions": PENDING_SQL + " SELECT DISTINCT sha256(question) AS question_id, question FROM asked",
    "extract_json": """
SELECT conv_id, turn, CASE WHEN ok THEN CAST(conv_id AS VARCHAR) END AS conv,
       CASE WHEN ok THEN CAST(turn AS VARCHAR) END AS n,
       CASE WHEN ok THEN CAST(length('{"conv": ' || conv_id || ', "turn": {"n": ' || turn || '}}') AS VARCHAR) END AS length
FROM (SELECT *, turn % 4 IN (0, 3) AS ok FROM conversations)""",
    "merge_suggestions": PENDING_SQL + """
SELECT cp_id, verdict, 'wrong "area"' AS issue, good AS correct_postcode,
       CAST(pw AS VARCHAR) AS postcode_wrong, CAST(cw AS VARCHAR) AS coords_wrong,
       substr(sha256(question), 1, 8) AS request_id, 'true' AS ai_reviewed,
       CASE WHEN pw AND good <> '' THEN good END AS suggested_postcode,
       CASE WHEN cw AND good <> '' THEN round(rlat, 6) END AS suggested_latitude,
       CASE WHEN cw AND good <> '' THEN round(rlon, 6) END AS suggested_longitude
FROM answered""",
    "review_queue": PENDING_SQL + """
SELECT p.cp_id, p.message, p.verdict, p.coord_postcode, CASE WHEN a.pw AND a.good <> '' THEN a.good END AS suggested_postcode,
       CASE WHEN a.cp_id IS NULL THEN p.description END AS description
FROM pending p LEFT JOIN answered a ON p.cp_id = a.cp_id ORDER BY p.verdict""",
    "dismiss": _WITH_REGISTER + f"""
SELECT check_name, entity_id, CASE WHEN hit THEN 'dismissed' ELSE status END AS status,
       strftime(CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE resolved_at END, '%Y-%m-%d') AS resolved_at
FROM (SELECT *, check_name = '{CHECK}' AND CAST(entity_id AS BIGINT) % 5 = 0 AS hit FROM register)""",
}
