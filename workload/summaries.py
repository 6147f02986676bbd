"""Queries on subtotals, stored sketches, range frames, previous rows and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgauge.operators import frames as R, summaries as S
from demandgauge.functions.times import month_key
from demandgauge.session import materialise

from . import inputs as I

SETS = [["area", "year_month", "connector"], ["area", "year_month"], ["area"], ["connector", "year_month"], ["year_month"], []]


def _placed(spark, d):
    area = F.when(F.col("user_id") % 18 != 17, F.element_at(
        F.array(*[F.lit(a) for a in I.AREA_CODES]), (F.col("user_id") % 17 + 1).cast("int")))
    return I.event_sessions(spark, d).select(
        "event_id", "cp_id", "connector", "start_time", "end_time", "consumption_kwh", "duration_minutes", area.alias("area"),
        F.date_format(F.date_add("start_time", (F.col("event_id") % 3 * 31).cast("int")), "yyyy-MM").alias("year_month"))


_PLACED_SQL = f"""{I.EVENT_SESSIONS_SQL},
placed AS (
  SELECT event_id, cp_id, connector, start_time, end_time, consumption_kwh, duration_minutes,
         CASE WHEN user_id % 18 <> 17 THEN {I.AREA_LIST_SQL}[CAST(user_id % 17 + 1 AS INTEGER)] END AS area,
         strftime(CAST(start_time AS DATE) + CAST(event_id % 3 * 31 AS INTEGER), '%Y-%m') AS year_month
  FROM sessions_all
)"""


def _subtotals(found):
    return found.select("area", "year_month", "connector", "level", "sessions", *[
        F.round(c, 4).alias(c) for c in ("energy_kwh", "occupied_minutes", "mean_minutes")])


def usage_grouping_sets(spark, d):
    return _subtotals(S.usage_subtotals(_placed(spark, d), SETS))


def usage_rollup(spark, d):
    return _subtotals(S.usage_subtotals(_placed(spark, d), S.rollup_sets(["area", "year_month", "connector"])))


def usage_cube(spark, d):
    return _subtotals(S.usage_subtotals(_placed(spark, d), S.cube_sets(["area", "year_month", "connector"])))


def _subtotals_sql(grouping: str) -> str:
    return f"""
WITH {_PLACED_SQL}
SELECT area, year_month, connector, CAST(grouping_id(area, year_month, connector) AS INTEGER) AS level, count(*) AS sessions,
       round(sum(consumption_kwh), 4) AS energy_kwh, round(sum(duration_minutes), 4) AS occupied_minutes,
       round(sum(duration_minutes) / count(duration_minutes), 4) AS mean_minutes
FROM placed GROUP BY {grouping}"""


def sketched_use(spark, d):
    """Distinct parts and quantiles of durations per point and year from monthly sketches, checked against exact values."""
    items = I.lineitem_sessions(spark, d)
    table = materialise(S.monthly_sketches(items, ["cp_id"], F.col("l_partkey")), "sketches")
    year = F.substring("year_month", 1, 4).alias("year")
    merged = S.merged_use(table.select("*", year), ["cp_id", "year"], [0.5, 0.9])
    of = [F.col("cp_id").alias("_cp"), F.substring(month_key(F.col("start_time")), 1, 4).alias("_year")]
    exact = items.select(*of, "l_partkey", "duration_minutes").groupBy("_cp", "_year").agg(
        F.countDistinct("l_partkey").alias("exact_users"))
    same = (F.col("cp_id") == F.col("_cp")) & (F.col("year") == F.col("_year"))
    # Ranks of the estimates: the share of rows at or below, and of those strictly below.
    ranked = items.select(*of, "duration_minutes").join(merged, same).groupBy("cp_id", "year").agg(*[
        F.struct(F.avg((F.col("duration_minutes") < F.col(q)).cast("int")).alias("low"), F.avg((F.col("duration_minutes") <= F.col(q)).cast("int")).alias("high")).alias(q)
        for q in ("q50", "q90")])
    checked = merged.select("cp_id", "year", "sessions", "users").join(exact, same).join(ranked, ["cp_id", "year"])
    within = [((F.col(q).low <= p + S.RANK_ERROR) & (F.col(q).high >= p - S.RANK_ERROR)).alias(f"{q}_within") for q, p in (("q50", 0.5), ("q90", 0.9))]
    error = F.abs(F.col("users") - F.col("exact_users"))
    return checked.select("cp_id", "year", "sessions", "exact_users", (error <= F.ceil(S.DISTINCT_ERROR * F.col("exact_users"))).alias("users_within"), *within)


def week_of_use(spark, d):
    """Sessions and energy of each point in the seven days up to each session."""
    rows = _placed(spark, d).select("event_id", "cp_id", "start_time", "consumption_kwh")
    found = R.rolling(rows, ["cp_id"], "start_time", 7 * 86400, {
        "sessions_7d": F.count(F.lit(1)), "energy_7d": F.sum("consumption_kwh"), "largest_7d": F.max("consumption_kwh")})
    return found.select("event_id", "cp_id", "sessions_7d", F.round("energy_7d", 4).alias("energy_7d"), "largest_7d")


def idle_before(spark, d):
    """Seconds from the end of the session before (by start) of each point to the start, -1 for its first."""
    items = I.lineitem_sessions(spark, d).select("cp_id", "start_time", "end_time", "l_orderkey", "l_linenumber", "l_partkey", "duration_minutes")
    one = items.groupBy("cp_id", "start_time", "l_orderkey", "l_linenumber", "l_partkey").agg(F.max("end_time").alias("end_time"))
    found = R.with_previous(one, ["cp_id"], ["start_time", "l_orderkey", "l_linenumber", "l_partkey"], {"end_time": "end_before", "l_orderkey": "order_before"})
    return found.select("cp_id", "l_orderkey", "l_linenumber", "l_partkey", F.coalesce("order_before", F.lit(-1)).alias("order_before"), F.coalesce(
        F.unix_seconds("start_time") - F.unix_seconds("end_before"), F.lit(-1)).alias("idle_s"))


def duration_tiles(spark, d):
    """Every session's place by duration and its tile of seven."""
    rows = _placed(spark, d).select("event_id", "duration_minutes")
    found = R.with_row_number(rows, ["duration_minutes", "event_id"], "place", "n")
    return found.select("event_id", "place", R.ntile("place", "n", 7).alias("tile"))


QUERIES = {f.__name__: f for f in (
    usage_grouping_sets, usage_rollup, usage_cube, sketched_use, week_of_use, idle_before, duration_tiles)}
ORACLE = {
    "usage_grouping_sets": _subtotals_sql(
        "GROUPING SETS ((area, year_month, connector), (area, year_month), (area), (connector, year_month), (year_month), ())"),
    "usage_rollup": _subtotals_sql("ROLLUP (area, year_month, connector)"),
    "usage_cube": _subtotals_sql("CUBE (area, year_month, connector)"),
    "sketched_use": f"""
WITH {I.LINEITEM_SESSIONS_SQL}
SELECT cp_id, strftime(start_time, '%Y') AS year, count(*) AS sessions, count(DISTINCT l_partkey) AS exact_users,
       TRUE AS users_within, TRUE AS q50_within, TRUE AS q90_within
FROM items GROUP BY ALL""",
    "week_of_use": f"""
WITH {_PLACED_SQL}
SELECT event_id, cp_id, count(*) OVER w AS sessions_7d, round(sum(consumption_kwh) OVER w, 4) AS energy_7d, max(consumption_kwh) OVER w AS largest_7d
FROM placed WINDOW w AS (PARTITION BY cp_id ORDER BY start_time RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)""",
    "idle_before": f"""
WITH {I.LINEITEM_SESSIONS_SQL},
one AS (SELECT cp_id, start_time, l_orderkey, l_linenumber, l_partkey, max(end_time) AS end_time FROM items GROUP BY ALL),
told AS (
  SELECT *, lag(end_time) OVER w AS end_before, lag(l_orderkey) OVER w AS order_before
  FROM one WINDOW w AS (PARTITION BY cp_id ORDER BY start_time, l_orderkey, l_linenumber, l_partkey))
SELECT cp_id, l_orderkey, l_linenumber, l_partkey, coalesce(order_before, -1) AS order_before,
       coalesce(CAST(epoch(start_time) - epoch(end_before) AS BIGINT), -1) AS idle_s
FROM told""",
    "duration_tiles": f"""
WITH {_PLACED_SQL}
SELECT event_id, row_number() OVER w AS place, CAST(ntile(7) OVER w AS INTEGER) AS tile
FROM placed WINDOW w AS (ORDER BY duration_minutes NULLS FIRST, event_id)""",
}
