"""Queries on event-time streams: the events in deliveries, some of them late, repeated, or of two kinds."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from demandgauge.session import working_folder
from demandgauge.streaming import event_time as E

from . import inputs as I

#: Six-day periods of the 30 days, and how many more deliveries late rows come in.
PERIOD_DAYS, PERIODS, LATEST = 6, 5, 2
LATE = "2 days"
KEYS = ["cp_id", "connector", "event_id"]


def _period(time: str = "start_time"):
    return F.floor((F.unix_seconds(time) - F.lit(1704067200)) / (86400 * PERIOD_DAYS)).cast("int")


def streamed(spark: SparkSession, sources: list[tuple[DataFrame, int]], build: Callable[..., DataFrame]) -> DataFrame:
    """The table that a stream has written after all deliveries; every delivery is a run of its own from the checkpoint.

    ``sources``: rows with a column ``delivery``, and the number of deliveries.
    """
    base = os.path.join(working_folder(spark), f"event-time-{uuid.uuid4().hex}")
    staged, streams = [], []
    for i, (rows, _) in enumerate(sources):
        rows.write.partitionBy("delivery").parquet(f"{base}/staged-{i}")
        schema = rows.drop("delivery").schema
        staged.append(spark.read.schema(rows.schema).parquet(f"{base}/staged-{i}"))
        spark.createDataFrame([], schema).write.parquet(f"{base}/in-{i}")
        streams.append(E.arrivals(spark, f"{base}/in-{i}", schema))
    result = build(*streams)
    for n in range(max(k for _, k in sources)):
        for i, rows in enumerate(staged):
            rows.where(F.col("delivery") == n).drop("delivery").write.mode("append").parquet(f"{base}/in-{i}")
        E.append_available(result, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/out")


def _sessions(spark, d) -> DataFrame:
    return I.event_sessions(spark, d).select(
        "event_id", "cp_id", "connector", "start_time", "duration_minutes", F.col("consumption_kwh"))


def deliveries(spark, d) -> DataFrame:
    """Sessions by period; one in 20 comes a delivery later, one in 50 two deliveries later."""
    k = F.col("event_id")
    more = F.when(k % 50 == 3, LATEST).when(k % 20 == 7, 1).otherwise(0)
    return _sessions(spark, d).withColumn("delivery", _period() + more)


def _shown(windows: DataFrame, *keys: str) -> DataFrame:
    return windows.select(
        F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), *keys, "sessions",
        F.round("energy_kwh", 6).alias("energy_kwh"), F.round("occupied_minutes", 6).alias("occupied_minutes"))


def tumbling_windows(spark, d):
    """Use per day and connector."""
    rows = deliveries(spark, d)
    found = streamed(spark, [(rows, PERIODS + LATEST)], lambda s: E.usage_windows(s, E.tumbling("1 day"), ["connector"], LATE))
    return _shown(found, "connector")


def sliding_windows(spark, d):
    """Use per two days, every half day."""
    rows = deliveries(spark, d)
    found = streamed(spark, [(rows, PERIODS + LATEST)], lambda s: E.usage_windows(s, E.sliding("2 days", "12 hours"), [], LATE))
    return _shown(found)


def inactivity_windows(spark, d):
    """Busy times of each point, ended by 12 hours without a session.

    Late rows either come within the allowance or are far beyond it, so no row can tell apart a window that is closed.
    """
    k, day = F.col("event_id"), F.floor((F.unix_seconds("start_time") - F.lit(1704067200)) / 86400) % PERIOD_DAYS
    more = F.when(k % 50 == 3, LATEST).when((k % 20 == 7) & (day == PERIOD_DAYS - 1), 1).otherwise(0)
    rows = _sessions(spark, d).withColumn("delivery", _period() + more)
    found = streamed(spark, [(rows, PERIODS + LATEST)], lambda s: E.usage_windows(s, E.inactivity("12 hours"), ["cp_id"], LATE))
    return _shown(found, "cp_id")


def sessions_once(spark, d):
    """Sessions delivered again in the same, the next, or a far later delivery come through once."""
    k, rows = F.col("event_id"), _sessions(spark, d).withColumn("delivery", _period())
    again = F.array_compact(F.array(
        F.lit(0), F.when(k % 5 == 0, 0), F.when(k % 3 == 0, 1), F.when(k % 7 == 0, 2)))
    copies = rows.select("*", F.explode(again).alias("more")).withColumn("delivery", F.col("delivery") + F.col("more")).drop("more")
    found = streamed(spark, [(copies, PERIODS + LATEST)], lambda s: E.first_copies(s, KEYS, "7 days"))
    return found.select("event_id", "cp_id", "connector", F.unix_micros("start_time").alias("start_us"), "duration_minutes", "consumption_kwh")


def sessions_with_errors(spark, d):
    """Sessions with the errors of their point from ten minutes before to six hours after the start, by two streams."""
    rows = _sessions(spark, d).withColumn("delivery", _period())
    sessions = rows.where("connector <> 'error'").select("delivery", "event_id", "cp_id", "start_time")
    errors = rows.where("connector = 'error'").select(
        "delivery", F.col("event_id").alias("error_id"), "cp_id", F.col("start_time").alias("status_time"))
    found = streamed(spark, [(sessions, PERIODS), (errors, PERIODS)], lambda s, e: E.with_status(
        s, e, ["cp_id"], "10 minutes", "6 hours", LATE))
    return found.select("event_id", "cp_id", F.coalesce("error_id", F.lit(-1)).alias("error_id"))


_DELIVERED = f"""
raw AS (
  SELECT *, CAST(floor((epoch(start_time) - 1704067200) / {86400 * PERIOD_DAYS}) AS INTEGER) AS period,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS kwh,
         CAST(floor((epoch(start_time) - 1704067200) / 86400) AS INTEGER) % {PERIOD_DAYS} AS day
  FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS cp_id, event_type AS connector, ts AS start_time, value AS duration_minutes, props FROM events)
),
delivered AS (
  SELECT *, period + CASE WHEN event_id % 50 = 3 THEN {LATEST} WHEN event_id % 20 = 7 {{only}} THEN 1 ELSE 0 END AS delivery FROM raw
),
seen AS (
  SELECT delivery, max(epoch_ms(start_time)) - 172800000 AS mark FROM delivered GROUP BY delivery
),
marks AS (
  SELECT delivery, coalesce(max(mark) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mark FROM seen
),
final AS (SELECT max(mark) AS mark FROM seen)"""
_MEASURES = """count(*) AS sessions, round(sum(kwh), 6) AS energy_kwh, round(sum(duration_minutes), 6) AS occupied_minutes"""


def _fixed_windows(width_s: int, every_s: int, keys: str) -> str:
    """Every row in each of its windows that had not ended by the watermark before its delivery."""
    return f"""
WITH {_DELIVERED.format(only='')},
placed AS (
  SELECT *, (CAST(floor(epoch(start_time) / {every_s}) AS BIGINT) - unnest(range(0, {width_s // every_s}))) * {every_s} AS s FROM delivered
)
SELECT s * 1000000 AS start_us, (s + {width_s}) * 1000000 AS end_us, {keys} {_MEASURES}
FROM placed JOIN marks USING (delivery), final
WHERE (s + {width_s}) * 1000 > marks.mark AND (s + {width_s}) * 1000 <= final.mark
GROUP BY {keys} s"""


QUERIES = {f.__name__: f for f in (tumbling_windows, sliding_windows, inactivity_windows, sessions_once, sessions_with_errors)}
ORACLE = {
    "tumbling_windows": _fixed_windows(86400, 86400, "connector,"),
    "sliding_windows": _fixed_windows(172800, 43200, ""),
    "inactivity_windows": f"""
WITH {_DELIVERED.format(only=f'AND day = {PERIOD_DAYS - 1}')},
kept AS (
  SELECT d.*, epoch_us(start_time) AS us FROM delivered d JOIN marks USING (delivery) WHERE epoch_ms(start_time) + 43200000 > mark
),
cut AS (
  SELECT *, CASE WHEN us - lag(us) OVER w < 43200000000 THEN 0 ELSE 1 END AS first FROM kept WINDOW w AS (PARTITION BY cp_id ORDER BY us)
),
numbered AS (SELECT *, sum(first) OVER (PARTITION BY cp_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS n FROM cut)
SELECT min(us) AS start_us, max(us) + 43200000000 AS end_us, cp_id, {_MEASURES}
FROM numbered, final GROUP BY cp_id, n, mark HAVING (max(us) + 43200000000) // 1000 <= mark""",
    "sessions_once": """
SELECT event_id, CAST(user_id AS VARCHAR) AS cp_id, event_type AS connector, epoch_us(ts) AS start_us, value AS duration_minutes,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS consumption_kwh
FROM events""",
    "sessions_with_errors": """
WITH final AS (
  SELECT least(max(epoch_ms(ts)) FILTER (WHERE event_type <> 'error'), max(epoch_ms(ts)) FILTER (WHERE event_type = 'error')) - 172800000 AS mark
  FROM events
),
errors AS (SELECT event_id AS error_id, user_id, ts AS at FROM events WHERE event_type = 'error'),
found AS (
  SELECT event_id, CAST(e.user_id AS VARCHAR) AS cp_id, e.ts, error_id
  FROM events e LEFT JOIN errors x ON e.user_id = x.user_id AND x.at BETWEEN e.ts - INTERVAL 10 MINUTES AND e.ts + INTERVAL 6 HOURS
  WHERE event_type <> 'error'
)
SELECT event_id, cp_id, coalesce(error_id, -1) AS error_id
FROM found, final WHERE error_id IS NOT NULL OR epoch_ms(ts) + 21600000 < mark""",
}
