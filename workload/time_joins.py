"""Queries on joins over time: sessions in outages, tariffs at the start of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandgauge.operators.asof import asof_join
from demandgauge.operators.intervals import interval_join

from . import inputs as I


def outages(spark, d) -> DataFrame:
    """Orders as outages of a point: from half an hour to ten hours, one in 97 of 200 days."""
    k = F.col("o_orderkey")
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 24 * 3600
    minutes = F.when(k % 97 == 0, 288000).otherwise(30 + k % 600)
    return I.table(spark, d, "orders").select(
        F.floor(F.col("o_custkey") / 15).cast("string").alias("cp_id"), k.alias("outage"),
        F.timestamp_seconds(start).alias("out_from"), F.timestamp_seconds(start + minutes * 60).alias("out_until"))


OUTAGES_SQL = """
outages AS (
  SELECT CAST(o_custkey // 15 AS VARCHAR) AS cp_id, o_orderkey AS outage, o_orderdate + to_hours(o_orderkey % 24) AS out_from,
         o_orderdate + to_hours(o_orderkey % 24)
           + to_minutes(CASE WHEN o_orderkey % 97 = 0 THEN 288000 ELSE 30 + o_orderkey % 600 END) AS out_until
  FROM orders
)"""


def _overlap():
    return F.unix_seconds(F.least("end_time", "out_until")) - F.unix_seconds(F.greatest("start_time", "out_from"))


def sessions_in_outages(spark, d):
    """Every pair of a session and an outage of its point that overlap."""
    items = I.lineitem_sessions(spark, d).select("cp_id", "start_time", "end_time", "l_orderkey", "l_linenumber")
    met = interval_join(items, outages(spark, d), ["cp_id"], ("start_time", "end_time"), ("out_from", "out_until"))
    return met.select("l_orderkey", "l_linenumber", "outage", _overlap().alias("overlap_s"))


def _one_hot(df: DataFrame, key: str) -> DataFrame:
    """A third of all rows on one point."""
    return df.withColumn("cp_id", F.when(F.col(key) % 3 == 0, "hot").otherwise(F.col("cp_id")))


def outage_load(spark, d):
    """Sessions met and seconds lost per outage, where one point holds a third of all rows."""
    items = _one_hot(I.lineitem_sessions(spark, d).select("cp_id", "start_time", "end_time", "l_orderkey"), "l_orderkey")
    met = interval_join(items, _one_hot(outages(spark, d), "outage"), ["cp_id"], ("start_time", "end_time"), ("out_from", "out_until"),
                        load=("sessions", "lost_s"))
    return met.groupBy("cp_id", "outage").agg(F.sum("sessions").alias("sessions"), F.sum("lost_s").alias("lost_s"))


def tariffs(spark, d) -> DataFrame:
    """Orders as tariffs of an area; several may begin at the same hour."""
    k = F.col("o_orderkey")
    area = F.element_at(F.array(*[F.lit(a) for a in I.AREA_CODES]), (F.col("o_custkey") % len(I.AREA_CODES) + 1).cast("int"))
    return I.table(spark, d, "orders").select(
        area.alias("area"), F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 5 * 3600).alias("valid_from"),
        k.alias("tariff"), F.col("o_totalprice").alias("price"))


def tariff_at_start(spark, d):
    """The tariff in force when each session starts."""
    # Only the first 12 areas are served; sessions elsewhere stay without a tariff.
    area = F.element_at(F.array(*[F.lit(a) for a in [*I.AREA_CODES[:12], "XX"]]), (F.col("l_suppkey") % 13 + 1).cast("int"))
    items = I.lineitem_sessions(spark, d).select("l_orderkey", "l_linenumber", area.alias("area"), (
        F.timestamp_seconds(F.unix_seconds("start_time") + F.col("l_partkey") % 86400)).alias("start_time"))
    found = asof_join(items, tariffs(spark, d), ["area"], "start_time", "valid_from", tie=["tariff"])
    return found.select("l_orderkey", "l_linenumber", "area", F.unix_seconds("start_time").alias("start_s"),
                        F.coalesce(F.unix_seconds("valid_from"), F.lit(-1)).alias("valid_s"),
                        F.coalesce("tariff", F.lit(-1)).alias("tariff"), "price")


_OVERLAP_SQL = """CAST(epoch(least(end_time, out_until)) - epoch(greatest(start_time, out_from)) AS BIGINT)"""
_MEET_SQL = "i.cp_id = o.cp_id AND i.start_time < o.out_until AND o.out_from < i.end_time AND i.start_time < i.end_time"

QUERIES = {f.__name__: f for f in (sessions_in_outages, outage_load, tariff_at_start)}
ORACLE = {
    "sessions_in_outages": f"""
WITH {I.LINEITEM_SESSIONS_SQL}, {OUTAGES_SQL}
SELECT l_orderkey, l_linenumber, outage, {_OVERLAP_SQL} AS overlap_s
FROM items i JOIN outages o ON {_MEET_SQL}""",
    "outage_load": f"""
WITH {I.LINEITEM_SESSIONS_SQL}, {OUTAGES_SQL},
i AS (SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE cp_id END AS cp_id) FROM items),
o AS (SELECT * REPLACE (CASE WHEN outage % 3 = 0 THEN 'hot' ELSE cp_id END AS cp_id) FROM outages)
SELECT i.cp_id, outage, count(*) AS sessions, CAST(sum({_OVERLAP_SQL}) AS BIGINT) AS lost_s
FROM i JOIN o ON {_MEET_SQL} GROUP BY ALL""",
    "tariff_at_start": f"""
WITH {I.LINEITEM_SESSIONS_SQL},
sessions AS (
  SELECT l_orderkey, l_linenumber, start_time + to_seconds(l_partkey % 86400) AS start_time,
         ['AB', 'DD', 'DG', 'EH', 'FK', 'G', 'HS', 'IV', 'KA', 'KW', 'KY', 'ML', 'XX'][CAST(l_suppkey % 13 + 1 AS INTEGER)] AS area
  FROM items),
tariffs AS (
  SELECT {I.AREA_LIST_SQL}[CAST(o_custkey % 17 + 1 AS INTEGER)] AS area,
         o_orderdate + to_hours(o_orderkey % 5) AS valid_from, max(o_orderkey) AS tariff, arg_max(o_totalprice, o_orderkey) AS price
  FROM orders GROUP BY ALL)
SELECT l_orderkey, l_linenumber, s.area, CAST(epoch(start_time) AS BIGINT) AS start_s, coalesce(CAST(epoch(valid_from) AS BIGINT), -1) AS valid_s,
       coalesce(tariff, -1) AS tariff, price
FROM sessions s ASOF LEFT JOIN tariffs t ON s.area = t.area AND s.start_time >= t.valid_from""",
}
