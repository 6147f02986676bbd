"""Queries on sites and serving queries on sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandgauge import constants as K
from demandgauge.operators import profiles as V, sites as S
from demandgauge.sources.tables import postcode_areas

from . import inputs as I
from .pressure import FULL_INDEX_SQL, index

AREA = "DG"

# Sites, over the CTE `idx`.
SITES_SQL = """
rolled AS (
  SELECT latitude, longitude,
         arg_min(site_name, cp_id) FILTER (WHERE site_name IS NOT NULL) AS site_name,
         arg_min(postcode, cp_id) FILTER (WHERE postcode IS NOT NULL) AS postcode,
         arg_min(postcode_area, cp_id) FILTER (WHERE postcode_area IS NOT NULL) AS postcode_area,
         count(DISTINCT cp_id) AS n_charge_points, CAST(sum(n_connectors) AS BIGINT) AS n_connectors,
         CAST(sum(total_sessions) AS BIGINT) AS total_sessions, sum(total_energy_kwh) AS total_energy_kwh,
         sum(occupied_hours) AS occupied_hours, sum(available_connector_hours) AS available_connector_hours,
         sum(saturated_hours) AS saturated_hours, sum(cp_available_hours) AS cp_available_hours
  FROM idx GROUP BY latitude, longitude
),
rated AS (
  SELECT *, least(coalesce(CASE WHEN available_connector_hours > 0
                                THEN occupied_hours / available_connector_hours END, 0), 1.0) AS utilisation,
         coalesce(CASE WHEN cp_available_hours > 0 THEN saturated_hours / cp_available_hours END, 0)
           AS saturation_rate,
         round(latitude, 6) || ',' || round(longitude, 6) AS site_key
  FROM rolled
),
ranks AS (
  SELECT *,
         (rank() OVER (ORDER BY saturation_rate)
          + (count(*) OVER (PARTITION BY saturation_rate) - 1) / 2.0::DOUBLE) / count(*) OVER () AS sat_pct,
         (rank() OVER (ORDER BY utilisation)
          + (count(*) OVER (PARTITION BY utilisation) - 1) / 2.0::DOUBLE) / count(*) OVER () AS util_pct
  FROM rated
),
sites AS (
  SELECT *, rank() OVER (ORDER BY pressure_score DESC) AS pressure_rank FROM (
    SELECT *, (0.6::DOUBLE * sat_pct + 0.4::DOUBLE * util_pct) / 1.0::DOUBLE AS pressure_score FROM ranks)
)"""
WITH_SITES = f"{FULL_INDEX_SQL}, {SITES_SQL}"
AREA_NAME_SQL = "CASE postcode_area " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in K.POSTCODE_AREAS.items()) + " ELSE postcode_area END"

_SUMS = ["total_energy_kwh", "occupied_hours", "available_connector_hours", "saturated_hours",
         "cp_available_hours"]


def sites(spark, d) -> DataFrame:
    return S.site_view(index(spark, d))


def _round(columns, digits=6):
    return [F.round(c, digits).alias(c) for c in columns]


def site_rollup(spark, d):
    return S.site_rollup(index(spark, d)).select(
        "latitude", "longitude", "site_name", "postcode", "postcode_area", "n_charge_points",
        "n_connectors", "total_sessions", *_round(_SUMS))


def site_members(spark, d):
    return S.site_members(index(spark, d)).select("site_key", "cp_id")


def site_rates(spark, d):
    return S.site_rates(S.site_rollup(index(spark, d))).select(
        "latitude", "longitude", *_round(["utilisation", "saturation_rate"], 9))


def site_rank(spark, d):
    return sites(spark, d).select(
        "latitude", "longitude", "pressure_rank", *_round(["pressure_score"], 9))


def site_key(spark, d):
    return S.site_rollup(index(spark, d)).select("latitude", "longitude", "site_key")


def site_card(spark, d):
    return S.site_cards(sites(spark, d)).select(
        "site_key", "site_name", "postcode", "n_charge_points", "n_connectors", "total_sessions",
        *_round(["pressure_score", "total_energy_mwh", "utilisation", "saturation_rate"], 9))


def region_sites(spark, d):
    return S.region_sites(sites(spark, d), AREA).select("site_key", "site_name", "pressure_rank")


def distinct_areas(spark, d):
    return S.distinct_areas(S.site_rollup(index(spark, d)))


def area_names(spark, d):
    return S.with_area_name(S.distinct_areas(S.site_rollup(index(spark, d))))


def area_names_by_table(spark, d):
    """The same names from the seeded reference table."""
    return S.with_area_name(S.distinct_areas(S.site_rollup(index(spark, d))), postcode_areas(spark))


def region_centre(spark, d):
    return S.region_centre(S.site_rollup(index(spark, d))).select(
        "postcode_area", "n_sites", *_round(["latitude", "longitude"]))


def highlighted_sites(spark, d):
    return S.highlight(S.site_rollup(index(spark, d)), AREA).select("site_key", "in_region")


def _sessions_in_area(spark, d):
    """Usage sessions of the charge points in one postcode area."""
    members = I.connectors(spark, d).where(F.upper(F.trim("postcode")).startswith("G"))
    return V.sessions_of(I.usage_sessions(spark, d), members)


_AREA_SESSIONS = f"""WITH {I.USAGE_SESSIONS_SQL}, {I.CONNECTORS_SQL},
chosen AS (
  SELECT * FROM sessions WHERE cp_id IN (
    SELECT cp_id FROM connectors WHERE upper(trim(postcode)) LIKE 'G%')
)"""


def sessions_of_area(spark, d):
    return _sessions_in_area(spark, d).select("event_id", "cp_id")


def weekday_hour(spark, d):
    return V.weekday_hour(_sessions_in_area(spark, d))


def weekday_hour_dense(spark, d):
    return V.weekday_hour_grid(_sessions_in_area(spark, d)).select("dow", "hour", "sessions")


def weekday_hour_wide(spark, d):
    return V.wide_grid(V.weekday_hour_grid(_sessions_in_area(spark, d)), "dow").drop("row_no")


def hour_duration_band(spark, d):
    return V.hour_duration(_sessions_in_area(spark, d))


def hour_duration_dense(spark, d):
    return V.hour_duration_grid(_sessions_in_area(spark, d)).select("dur_band", "row_no", "hour", "sessions")


def day_counts(spark, d):
    return V.day_counts(_sessions_in_area(spark, d))


def average_profile(spark, d):
    s = _sessions_in_area(spark, d)
    return V.average_profile(V.weekday_hour(s), V.day_counts(s))


def monthly_trend(spark, d):
    return V.monthly_trend(I.lineitem_sessions(spark, d))


def monthly_trend_by_cp(spark, d):
    return V.monthly_trend(I.lineitem_sessions(spark, d), ["cp_id"])


def period(spark, d):
    return V.period(I.usage_sessions(spark, d)).select(
        F.col("date_min").cast("string").alias("date_min"), F.col("date_max").cast("string").alias("date_max"))


def site_bundle(spark, d):
    idx = index(spark, d)
    bundle = V.site_bundle(I.usage_sessions(spark, d), S.site_members(idx))
    return bundle.withColumns({c: F.col(c).cast("string") for c in ("dow", "hour")})


QUERIES = {
    "site_rollup": site_rollup,
    "site_members": site_members,
    "site_rates": site_rates,
    "site_rank": site_rank,
    "site_key": site_key,
    "site_card": site_card,
    "region_sites": region_sites,
    "distinct_areas": distinct_areas,
    "area_names": area_names,
    "area_names_by_table": area_names_by_table,
    "region_centre": region_centre,
    "highlighted_sites": highlighted_sites,
    "sessions_of_area": sessions_of_area,
    "weekday_hour": weekday_hour,
    "weekday_hour_dense": weekday_hour_dense,
    "weekday_hour_wide": weekday_hour_wide,
    "hour_duration_band": hour_duration_band,
    "hour_duration_dense": hour_duration_dense,
    "day_counts": day_counts,
    "average_profile": average_profile,
    "monthly_trend": monthly_trend,
    "monthly_trend_by_cp": monthly_trend_by_cp,
    "period": period,
    "site_bundle": site_bundle,
}


def _sql_round(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


_BAND = "CASE " + " ".join(
    f"WHEN duration_minutes < {limit} THEN '{label}'" for limit, label in K.DURATION_BANDS
) + f" ELSE '{K.LONGEST_BAND}' END"
_BAND_VALUES = ", ".join(f"({i}, '{b}')" for i, b in enumerate(K.BAND_ORDER))
_DAY_TYPE = "CASE WHEN isodow(start_time) >= 6 THEN 'Weekend' ELSE 'Weekday' END"
_HOURS = "(SELECT unnest(generate_series(0, 23)) AS hour)"
_DENSE = f"""
SELECT g.dow::INTEGER AS dow, g.hour::INTEGER AS hour, coalesce(n, 0) AS sessions
FROM (SELECT * FROM (SELECT unnest(generate_series(0, 6)) AS dow), {_HOURS}) g
LEFT JOIN (SELECT isodow(start_time) - 1 AS dow, hour(start_time) AS hour, count(*) AS n
           FROM chosen GROUP BY ALL) c USING (dow, hour)"""

ORACLE = {
    "site_rollup": WITH_SITES + f"""
SELECT latitude, longitude, site_name, postcode, postcode_area, n_charge_points, n_connectors,
       total_sessions, {_sql_round(_SUMS)} FROM rolled""",
    "site_members": WITH_SITES + """
SELECT DISTINCT round(latitude, 6) || ',' || round(longitude, 6) AS site_key, cp_id FROM idx""",
    "site_rates": WITH_SITES + f"""
SELECT latitude, longitude, {_sql_round(['utilisation', 'saturation_rate'], 9)} FROM rated""",
    "site_rank": WITH_SITES + f"""
SELECT latitude, longitude, pressure_rank, {_sql_round(['pressure_score'], 9)} FROM sites""",
    "site_key": WITH_SITES + " SELECT latitude, longitude, site_key FROM rated",
    "site_card": WITH_SITES + f"""
SELECT site_key, site_name, postcode, n_charge_points, n_connectors, total_sessions,
       round(total_energy_kwh / 1000, 9) AS total_energy_mwh,
       {_sql_round(['pressure_score', 'utilisation', 'saturation_rate'], 9)} FROM sites""",
    "region_sites": WITH_SITES + f"""
SELECT site_key, site_name, pressure_rank FROM sites
WHERE postcode_area = '{AREA}' AND latitude IS NOT NULL AND longitude IS NOT NULL ORDER BY pressure_rank""",
    "distinct_areas": WITH_SITES + """
SELECT DISTINCT postcode_area FROM rolled WHERE postcode_area IS NOT NULL ORDER BY 1""",
    "area_names": WITH_SITES + f"""
SELECT DISTINCT postcode_area, {AREA_NAME_SQL} AS area_name FROM rolled WHERE postcode_area IS NOT NULL""",
    "area_names_by_table": WITH_SITES + f"""
SELECT DISTINCT postcode_area, {AREA_NAME_SQL} AS area_name FROM rolled WHERE postcode_area IS NOT NULL""",
    "region_centre": WITH_SITES + """
SELECT postcode_area, count(*) AS n_sites, round(avg(latitude), 6) AS latitude,
       round(avg(longitude), 6) AS longitude
FROM rolled WHERE postcode_area IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL
GROUP BY postcode_area""",
    "highlighted_sites": WITH_SITES + f"""
SELECT site_key, coalesce(postcode_area = '{AREA}', FALSE) AS in_region FROM rated
WHERE latitude IS NOT NULL AND longitude IS NOT NULL""",
    "sessions_of_area": _AREA_SESSIONS + " SELECT event_id, cp_id FROM chosen",
    "weekday_hour": _AREA_SESSIONS + """
SELECT CAST(isodow(start_time) - 1 AS INTEGER) AS dow, CAST(hour(start_time) AS INTEGER) AS hour,
       count(*) AS sessions FROM chosen GROUP BY ALL""",
    "weekday_hour_dense": _AREA_SESSIONS + _DENSE,
    "weekday_hour_wide": _AREA_SESSIONS + f""", grid AS ({_DENSE})
SELECT dow, """ + ", ".join(
        f"CAST(sum(CASE WHEN hour = {h} THEN sessions ELSE 0 END) AS BIGINT) AS h{h}" for h in range(24)
    ) + " FROM grid GROUP BY dow",
    "hour_duration_band": _AREA_SESSIONS + f"""
SELECT CAST(hour(start_time) AS INTEGER) AS hour, {_BAND} AS dur_band, count(*) AS sessions
FROM chosen GROUP BY ALL""",
    "hour_duration_dense": _AREA_SESSIONS + f"""
SELECT g.dur_band, g.row_no::INTEGER AS row_no, g.hour::INTEGER AS hour, coalesce(n, 0) AS sessions
FROM (SELECT * FROM (VALUES {_BAND_VALUES}) v(row_no, dur_band), {_HOURS}) g
LEFT JOIN (SELECT hour(start_time) AS hour, {_BAND} AS dur_band, count(*) AS n
           FROM chosen GROUP BY ALL) c USING (hour, dur_band)""",
    "day_counts": _AREA_SESSIONS + f"""
SELECT {_DAY_TYPE} AS day_type, count(DISTINCT CAST(start_time AS DATE)) AS days FROM chosen GROUP BY ALL""",
    "average_profile": _AREA_SESSIONS + f""",
days AS (SELECT {_DAY_TYPE} AS day_type, count(DISTINCT CAST(start_time AS DATE)) AS days
         FROM chosen GROUP BY ALL),
prof AS (SELECT {_DAY_TYPE} AS day_type, CAST(hour(start_time) AS INTEGER) AS hour, count(*) AS sessions
         FROM chosen GROUP BY ALL)
SELECT day_type, hour, sessions, sessions / coalesce(days, 1)::DOUBLE AS avg_sessions
FROM prof LEFT JOIN days USING (day_type)""",
    "monthly_trend": f"""WITH {I.LINEITEM_SESSIONS_SQL}
SELECT strftime(start_time, '%Y-%m') AS month, count(*) AS sessions FROM items GROUP BY ALL ORDER BY month""",
    "monthly_trend_by_cp": f"""WITH {I.LINEITEM_SESSIONS_SQL}
SELECT cp_id, strftime(start_time, '%Y-%m') AS month, count(*) AS sessions FROM items GROUP BY ALL""",
    "period": f"""WITH {I.USAGE_SESSIONS_SQL}
SELECT CAST(CAST(min(start_time) AS DATE) AS VARCHAR) AS date_min,
       CAST(CAST(max(start_time) AS DATE) AS VARCHAR) AS date_max FROM sessions""",
    "site_bundle": WITH_SITES + f""",
members AS (SELECT DISTINCT round(latitude, 6) || ',' || round(longitude, 6) AS site_key, cp_id FROM idx),
here AS (
  SELECT site_key, start_time, strftime(start_time, '%Y-%m') AS month,
         CAST(isodow(start_time) - 1 AS VARCHAR) AS dow, CAST(hour(start_time) AS VARCHAR) AS hour,
         {_BAND} AS dur_band, {_DAY_TYPE} AS day_type
  FROM sessions JOIN members USING (cp_id)
)
SELECT site_key, 'trend' AS part, month, NULL AS dow, NULL AS hour, NULL AS dur_band, NULL AS day_type,
       count(*) AS n FROM here GROUP BY site_key, month
UNION ALL SELECT site_key, 'profile', NULL, dow, hour, NULL, NULL, count(*) FROM here
GROUP BY site_key, dow, hour
UNION ALL SELECT site_key, 'hour_duration', NULL, NULL, hour, dur_band, NULL, count(*) FROM here
GROUP BY site_key, hour, dur_band
UNION ALL SELECT site_key, 'daycounts', NULL, NULL, NULL, NULL, day_type,
       count(DISTINCT CAST(start_time AS DATE)) FROM here GROUP BY site_key, day_type""",
}
