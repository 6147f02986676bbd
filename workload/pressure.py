"""Queries on sessions: sweep, availability, pressure index, percentiles."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, functions as F

from demandgauge.operators import pressure as P, ranking, sweep
from demandgauge.plans import sweep_run
from demandgauge.session import working_folder
from demandgauge.functions.text import postcode_area as area_of

from . import inputs as I

MIN_SESSIONS = 60

# Measures of every charge point, over the CTEs `filled` and `cp_ref`.
METRICS_SQL = """
known AS (SELECT f.*, n_connectors FROM filled f JOIN cp_ref USING (cp_id)),
changes AS (
  SELECT cp_id, n_connectors, t, sum(d) AS d FROM (
    SELECT cp_id, n_connectors, CAST(floor(epoch_us(start_time) / 1000000.0) AS BIGINT) AS t, 1 AS d FROM known
    UNION ALL
    SELECT cp_id, n_connectors, CAST(floor(epoch_us(end_filled) / 1000000.0) AS BIGINT) AS t, -1 AS d FROM known
  ) GROUP BY ALL
),
steps AS (
  SELECT cp_id, n_connectors, sum(d) OVER w AS running, lead(t) OVER w - t AS secs
  FROM changes WINDOW w AS (PARTITION BY cp_id ORDER BY t)
),
saturation AS (
  SELECT cp_id, sum(CASE WHEN n_connectors > 0 AND running >= n_connectors THEN coalesce(secs, 0) ELSE 0 END)
           / 3600.0::DOUBLE AS saturated_hours
  FROM steps GROUP BY cp_id
),
windows AS (
  SELECT cp_id, connector, min(start_time) AS first_seen, max(end_filled) AS last_seen,
         (CAST(floor(epoch_us(max(end_filled)) / 1000000.0) AS BIGINT)
          - CAST(floor(epoch_us(min(start_time)) / 1000000.0) AS BIGINT)) / 3600.0::DOUBLE AS available_hours
  FROM known GROUP BY cp_id, connector
),
availability AS (SELECT cp_id, sum(available_hours) AS available_connector_hours FROM windows GROUP BY cp_id),
totals AS (
  SELECT cp_id, count(*) AS total_sessions, sum(duration_minutes / 60) AS occupied_hours,
         sum(consumption_kwh) AS total_energy_kwh, sum(amount) AS total_revenue,
         (epoch_us(max(end_filled)) - epoch_us(min(start_time))) / 3.6e9 AS cp_available_hours
  FROM known GROUP BY cp_id
),
metrics AS (
  SELECT *,
         CASE WHEN available_connector_hours <> 0
              THEN least(occupied_hours / available_connector_hours, 1.0) END AS utilisation,
         CASE WHEN cp_available_hours <> 0 THEN saturated_hours / cp_available_hours END AS saturation_rate,
         CASE WHEN n_connectors <> 0 THEN total_revenue / n_connectors END AS revenue_per_connector,
         n_connectors = 1 AS single_connector
  FROM totals JOIN availability USING (cp_id) JOIN saturation USING (cp_id) JOIN cp_ref USING (cp_id)
)"""

# The ranked index, over the CTE `metrics`.
INDEX_SQL = METRICS_SQL + f""",
eligible AS (
  SELECT * FROM metrics
  WHERE total_sessions >= {MIN_SESSIONS} AND latitude IS NOT NULL AND longitude IS NOT NULL
),
pct AS (
  SELECT *, cume_dist() OVER (ORDER BY saturation_rate NULLS FIRST) AS saturation_rate_pct,
         cume_dist() OVER (ORDER BY utilisation NULLS FIRST) AS utilisation_pct
  FROM eligible
),
scored AS (
  SELECT *, (0.6::DOUBLE * saturation_rate_pct + 0.4::DOUBLE * utilisation_pct) / 1.0::DOUBLE AS pressure_score
  FROM pct
),
idx AS (
  SELECT *, rank() OVER (ORDER BY pressure_score DESC) AS pressure_rank,
         nullif(regexp_extract(upper(trim(postcode)), '^([A-Z]{{1,2}})', 1), '') AS postcode_area
  FROM scored
)"""

FULL_INDEX_SQL = f"WITH {I.USAGE_SESSIONS_SQL}, {I.CONNECTORS_SQL}, {INDEX_SQL}"

ITEM_CAPACITY_SQL = """
capacity AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS cp_id, CAST(s_suppkey % 4 AS INTEGER) AS n_connectors FROM supplier
)"""


def filled_sessions(spark, d) -> DataFrame:
    return P.with_end_filled(I.usage_sessions(spark, d))


def index(spark, d) -> DataFrame:
    return P.pressure_index(I.usage_sessions(spark, d), I.connectors(spark, d), MIN_SESSIONS)


def saturation_by_cp(spark, d):
    s = filled_sessions(spark, d).select(
        "cp_id", "start_time", F.col("end_time_filled").alias("end_time"))
    return sweep.saturated_hours(s, P.cp_reference(I.connectors(spark, d)))


def item_capacity(spark, d) -> DataFrame:
    key = F.col("s_suppkey")
    return I.table(spark, d, "supplier").select(
        key.cast("string").alias("cp_id"), (key % 4).cast("int").alias("n_connectors"))


def saturation_ties(spark, d):
    return sweep.saturated_hours(I.lineitem_sessions(spark, d), item_capacity(spark, d))


def concurrency_profile(spark, d):
    return sweep.seconds_by_level(I.lineitem_sessions(spark, d))


def incremental_levels(spark, d):
    """The concurrency profile in three runs over new files, one of them repeated as after a failure."""
    items, path = I.lineitem_sessions(spark, d), os.path.join(working_folder(spark), f"sweep-{uuid.uuid4().hex}")
    file = F.col("l_orderkey") % 12
    for run, files in ((0, file < 6), (1, file.between(6, 9)), (1, file.between(6, 9)), (2, file > 9)):
        sweep_run.add_sessions(spark, items.where(files).select("cp_id", "start_time", "end_time"), path, run)
    return sweep_run.stored_levels(spark, path, 3)


def sessions_with_k(spark, d):
    return (
        P.with_k(I.usage_sessions(spark, d), P.cp_reference(I.connectors(spark, d)))
        .groupBy("cp_id", "n_connectors").agg(F.count(F.lit(1)).alias("sessions"))
    )


def end_filled(spark, d):
    return filled_sessions(spark, d).select(
        "event_id", F.unix_micros("end_time_filled").alias("end_us"),
        F.round("occupied_hours", 6).alias("occupied_hours"))


def connector_windows(spark, d):
    return P.connector_windows(filled_sessions(spark, d)).select(
        "cp_id", "connector", F.unix_micros("first_seen").alias("first_us"),
        F.unix_micros("last_seen").alias("last_us"),
        F.round("available_hours", 6).alias("available_hours"))


def cp_available_hours(spark, d):
    return P.cp_usage(P.connector_windows(filled_sessions(spark, d))).select(
        "cp_id", F.round("available_connector_hours", 6).alias("available_connector_hours"),
        F.round("cp_available_hours", 6).alias("cp_available_hours"))


def cp_totals(spark, d):
    return P.cp_usage(P.connector_windows(filled_sessions(spark, d))).select(
        "cp_id", "total_sessions", F.round("occupied_hours", 6).alias("occupied_hours"),
        "total_energy_kwh", F.round("total_revenue", 6).alias("total_revenue"))


def cp_reference(spark, d):
    return P.cp_reference(I.connectors(spark, d))


_METRIC_COLUMNS = [
    "saturated_hours", "cp_available_hours", "occupied_hours", "available_connector_hours",
    "total_energy_kwh", "total_revenue", "utilisation", "saturation_rate", "revenue_per_connector",
]


def _rounded(columns):
    return [F.round(c, 6).alias(c) for c in columns]


def _rounded_sql(columns):
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def cp_metrics(spark, d):
    return P.cp_metrics(I.usage_sessions(spark, d), I.connectors(spark, d)).select(
        "cp_id", "total_sessions", "n_connectors", "single_connector", *_rounded(_METRIC_COLUMNS))


def pressure_index(spark, d):
    return P.gold(index(spark, d)).select(
        "cp_id", "pressure_rank", F.round("pressure_score", 9).alias("pressure_score"),
        *_rounded(_METRIC_COLUMNS), "total_sessions", "n_connectors", "single_connector",
        "site_name", "postcode", "postcode_area", "latitude", "longitude")


def _price_facts(spark, d) -> DataFrame:
    """Line items with a value of many ties and one with gaps (NULL)."""
    return I.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        F.when(F.col("l_partkey") % 13 != 0, F.col("l_extendedprice")).alias("price"))


_PRICE_SQL = """
facts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
         CASE WHEN l_partkey % 13 <> 0 THEN l_extendedprice END AS price
  FROM lineitem
)"""
_FACT_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def percentile_cume(spark, d):
    return ranking.with_percentiles(
        _price_facts(spark, d), cume={"price": "price_pct", "l_quantity": "quantity_pct"}
    ).select(*_FACT_KEYS, "price_pct", "quantity_pct")


def percentile_avg_rank(spark, d):
    return ranking.with_percentiles(
        _price_facts(spark, d), average={"price": "price_pct", "l_quantity": "quantity_pct"}
    ).select(*_FACT_KEYS, "price_pct", "quantity_pct")


def pressure_rank(spark, d):
    return ranking.with_percentiles(
        _price_facts(spark, d), descending={"price": "price_rank", "l_quantity": "quantity_rank"}
    ).select(*_FACT_KEYS, "price_rank", "quantity_rank")


def pressure_score(spark, d):
    scored = ranking.with_percentiles(
        _price_facts(spark, d), cume={"price": "price_pct", "l_quantity": "quantity_pct"})
    return scored.select(*_FACT_KEYS, P.weighted_score(
        {"price_pct": 0.6, "quantity_pct": 0.4}).alias("score"))


def postcode_area(spark, d):
    return I.connectors(spark, d).select(
        "cp_id", "connector_id", area_of(F.col("postcode")).alias("postcode_area"))


def rankable(spark, d):
    metrics = P.cp_metrics(I.usage_sessions(spark, d), I.connectors(spark, d))
    return P.rankable(metrics, MIN_SESSIONS).select("cp_id", "total_sessions", "latitude", "longitude")


QUERIES = {
    "saturation_by_cp": saturation_by_cp,
    "saturation_ties": saturation_ties,
    "concurrency_profile": concurrency_profile,
    "incremental_levels": incremental_levels,
    "sessions_with_k": sessions_with_k,
    "end_filled": end_filled,
    "connector_windows": connector_windows,
    "cp_available_hours": cp_available_hours,
    "cp_totals": cp_totals,
    "cp_reference": cp_reference,
    "cp_metrics": cp_metrics,
    "rankable": rankable,
    "pressure_index": pressure_index,
    "percentile_cume": percentile_cume,
    "percentile_avg_rank": percentile_avg_rank,
    "pressure_rank": pressure_rank,
    "pressure_score": pressure_score,
    "postcode_area": postcode_area,
}

_WITH_METRICS = f"WITH {I.USAGE_SESSIONS_SQL}, {I.CONNECTORS_SQL}, {METRICS_SQL}"
_ALL_FILLED = f"WITH {I.USAGE_SESSIONS_SQL}"
_ITEM_STEPS = f"""WITH {I.LINEITEM_SESSIONS_SQL}, {ITEM_CAPACITY_SQL},
changes AS (
  SELECT cp_id, t, sum(d) AS d FROM (
    SELECT cp_id, epoch(start_time)::BIGINT AS t, 1 AS d FROM items
    UNION ALL SELECT cp_id, epoch(end_time)::BIGINT AS t, -1 AS d FROM items
  ) GROUP BY ALL
),
steps AS (
  SELECT cp_id, sum(d) OVER w AS running, coalesce(lead(t) OVER w - t, 0) AS secs
  FROM changes WINDOW w AS (PARTITION BY cp_id ORDER BY t)
)"""

ORACLE = {
    "saturation_by_cp": _WITH_METRICS + " SELECT * FROM saturation",
    "saturation_ties": _ITEM_STEPS + """
SELECT cp_id, sum(CASE WHEN n_connectors > 0 AND running >= n_connectors THEN secs ELSE 0 END)
         / 3600.0::DOUBLE AS saturated_hours
FROM steps JOIN capacity USING (cp_id) GROUP BY cp_id""",
    "concurrency_profile": _ITEM_STEPS + """
SELECT cp_id, CAST(running AS BIGINT) AS running, CAST(sum(secs) AS BIGINT) AS seconds
FROM steps GROUP BY ALL""",
    "incremental_levels": _ITEM_STEPS + """
SELECT cp_id, CAST(running AS BIGINT) AS running, CAST(sum(secs) AS BIGINT) AS seconds
FROM steps WHERE running > 0 GROUP BY ALL HAVING sum(secs) > 0""",
    "sessions_with_k": _WITH_METRICS + """
SELECT cp_id, n_connectors, count(*) AS sessions FROM known GROUP BY ALL""",
    "end_filled": _ALL_FILLED + """
SELECT event_id, epoch_us(end_filled) AS end_us, round(duration_minutes / 60, 6) AS occupied_hours
FROM filled""",
    "connector_windows": _ALL_FILLED + """
SELECT cp_id, connector, epoch_us(min(start_time)) AS first_us, epoch_us(max(end_filled)) AS last_us,
       round((CAST(floor(epoch_us(max(end_filled)) / 1000000.0) AS BIGINT)
              - CAST(floor(epoch_us(min(start_time)) / 1000000.0) AS BIGINT)) / 3600.0::DOUBLE, 6)
         AS available_hours
FROM filled GROUP BY ALL""",
    "cp_available_hours": _ALL_FILLED + """, w AS (
  SELECT cp_id, min(start_time) AS f, max(end_filled) AS l FROM filled GROUP BY cp_id, connector
)
SELECT cp_id,
       round(sum((CAST(floor(epoch_us(l) / 1000000.0) AS BIGINT)
                  - CAST(floor(epoch_us(f) / 1000000.0) AS BIGINT)) / 3600.0::DOUBLE), 6)
         AS available_connector_hours,
       round((epoch_us(max(l)) - epoch_us(min(f))) / 3.6e9, 6) AS cp_available_hours
FROM w GROUP BY cp_id""",
    "cp_totals": _ALL_FILLED + """
SELECT cp_id, count(*) AS total_sessions, round(sum(duration_minutes / 60), 6) AS occupied_hours,
       sum(consumption_kwh) AS total_energy_kwh, round(sum(amount), 6) AS total_revenue
FROM filled GROUP BY cp_id""",
    "cp_reference": f"WITH {I.CONNECTORS_SQL} SELECT * FROM cp_ref",
    "cp_metrics": _WITH_METRICS + f"""
SELECT cp_id, total_sessions, n_connectors, single_connector, {_rounded_sql(_METRIC_COLUMNS)}
FROM metrics""",
    "rankable": FULL_INDEX_SQL + " SELECT cp_id, total_sessions, latitude, longitude FROM eligible",
    "pressure_index": FULL_INDEX_SQL + f"""
SELECT cp_id, CAST(pressure_rank AS INTEGER) AS pressure_rank,
       round(pressure_score, 9) AS pressure_score, {_rounded_sql(_METRIC_COLUMNS)}, total_sessions,
       n_connectors, single_connector, site_name, postcode, postcode_area, latitude, longitude
FROM idx""",
    "percentile_cume": f"""WITH {_PRICE_SQL}
SELECT l_orderkey, l_linenumber, l_partkey,
       cume_dist() OVER (ORDER BY price NULLS FIRST) AS price_pct,
       cume_dist() OVER (ORDER BY l_quantity NULLS FIRST) AS quantity_pct
FROM facts""",
    "percentile_avg_rank": f"""WITH {_PRICE_SQL}
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN price IS NOT NULL THEN
         (rank() OVER (ORDER BY price NULLS LAST) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE)
         / count(price) OVER () END AS price_pct,
       (rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE)
         / count(l_quantity) OVER () AS quantity_pct
FROM facts""",
    "pressure_rank": f"""WITH {_PRICE_SQL}
SELECT l_orderkey, l_linenumber, l_partkey,
       rank() OVER (ORDER BY price DESC NULLS LAST) AS price_rank,
       rank() OVER (ORDER BY l_quantity DESC NULLS LAST) AS quantity_rank
FROM facts""",
    "pressure_score": f"""WITH {_PRICE_SQL}
SELECT l_orderkey, l_linenumber, l_partkey,
       (0.6::DOUBLE * cume_dist() OVER (ORDER BY price NULLS FIRST)
        + 0.4::DOUBLE * cume_dist() OVER (ORDER BY l_quantity NULLS FIRST)) / 1.0::DOUBLE AS score
FROM facts""",
    "postcode_area": f"""WITH {I.CONNECTORS_SQL}
SELECT cp_id, connector_id,
       nullif(regexp_extract(upper(trim(postcode)), '^([A-Z]{{1,2}})', 1), '') AS postcode_area
FROM connectors""",
}
