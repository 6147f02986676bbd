"""The given test tables in the shapes of sessions, connectors, locations and links.

Each adapter exists twice: as a DataFrame function and as SQL text for the oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from demandgauge.functions.frames import computed_once

AREA_CODES = [
    "AB", "DD", "DG", "EH", "FK", "G", "HS", "IV", "KA", "KW", "KY", "ML", "PA", "PH", "TD", "ZE",
    "M",
]
AREA_LIST_SQL = "[" + ", ".join(f"'{a}'" for a in AREA_CODES) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# ---------------------------------------------------------------- events as sessions

def kwh_of_props():
    return F.get_json_object("props", "$.k").cast("double")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as sessions, valid or not."""
    start = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + F.floor(F.col("value") * 60).cast("long") * 1000000)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("cp_id"),
        F.col("event_type").alias("connector"),
        start.alias("start_time"),
        F.when(F.col("event_id") % 10 != 0, end).alias("end_time"),
        F.col("value").alias("duration_minutes"),
        kwh_of_props().alias("consumption_kwh"),
        F.when(F.col("event_id") % 7 != 0, F.col("value") * 0.25).alias("amount"),
        F.concat(F.lit("events_"), (F.col("event_id") % 12).cast("string")).alias("source_file"),
        "event_id",
        "user_id",
        "props",
    )


EVENT_SESSIONS_SQL = """
sessions_all AS (
  SELECT CAST(user_id AS VARCHAR) AS cp_id, event_type AS connector, ts AS start_time,
         CASE WHEN event_id % 10 <> 0
              THEN ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) END AS end_time,
         value AS duration_minutes,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS consumption_kwh,
         CASE WHEN event_id % 7 <> 0 THEN value * 0.25 END AS amount,
         'events_' || CAST(event_id % 12 AS VARCHAR) AS source_file,
         event_id, user_id
  FROM events
)"""


def usage_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event sessions within the energy and duration limits; a missing end time stays missing."""
    kwh, minutes = F.col("consumption_kwh"), F.col("duration_minutes")
    sessions = event_sessions(spark, sf_dir)
    read = computed_once(sessions.drop("consumption_kwh"), {"consumption_kwh": kwh_of_props()})
    return read.where((kwh > 0) & (kwh <= 300) & (minutes > 1) & (minutes <= 1440))


USAGE_SESSIONS_SQL = EVENT_SESSIONS_SQL + """,
sessions AS (
  SELECT * FROM sessions_all
  WHERE consumption_kwh > 0 AND consumption_kwh <= 300
    AND duration_minutes > 1 AND duration_minutes <= 1440
),
filled AS (
  SELECT *, coalesce(end_time, make_timestamp(
              CAST(floor((floor(epoch_us(start_time) / 1000000.0::DOUBLE) + duration_minutes * 60)
                         * 1000000.0::DOUBLE) AS BIGINT))) AS end_filled
  FROM sessions
)"""


# ---------------------------------------------------------------- connectors

def connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charge points derived from the users that occur in events, one row per connector."""
    u = F.col("user_id")
    area = F.element_at(F.array(*[F.lit(a) for a in AREA_CODES]), (u % 18 + 1).cast("int"))
    postcode = F.concat(area, (u % 9 + 1).cast("string"), F.lit(" 1AB"))
    return (
        table(spark, sf_dir, "events").select("user_id").distinct()
        .where(u % 31 != 0)
        .select(
            "user_id",
            u.cast("string").alias("cp_id"),
            (1 + u % 3).cast("int").alias("n_connectors"),
            F.when(u % 11 != 0, F.concat(F.lit("site "), u.cast("string"))).alias("site_name"),
            F.when(u % 18 == 17, F.lit(None)).when(u % 5 == 0, F.concat(F.lit(" "), F.lower(postcode)))
            .otherwise(postcode).alias("postcode"),
            F.when(u % 29 != 0, F.lit(55.0) + (u % 10).cast("double") / 10).alias("latitude"),
            F.when(u % 29 != 0, F.lit(-4.0) + (u % 3).cast("double") / 4).alias("longitude"),
            F.explode(F.sequence(F.lit(1), (1 + u % 3).cast("int"))).alias("connector_id"),
        )
        .withColumn("connector_id", F.col("connector_id").cast("string"))
        .withColumn("site_name", F.when(
            (F.col("connector_id") != "1") | (u % 7 != 0), F.col("site_name")))
    )


CONNECTORS_SQL = f"""
points AS (
  SELECT user_id, CAST(user_id AS VARCHAR) AS cp_id, CAST(1 + user_id % 3 AS INTEGER) AS n_connectors,
         CASE WHEN user_id % 11 <> 0 THEN 'site ' || CAST(user_id AS VARCHAR) END AS name,
         {AREA_LIST_SQL}[CAST(user_id % 18 + 1 AS INTEGER)] || CAST(user_id % 9 + 1 AS VARCHAR)
           || ' 1AB' AS pc,
         CASE WHEN user_id % 29 <> 0 THEN 55.0::DOUBLE + (user_id % 10)::DOUBLE / 10 END AS latitude,
         CASE WHEN user_id % 29 <> 0 THEN (-4.0)::DOUBLE + (user_id % 3)::DOUBLE / 4 END AS longitude
  FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 31 <> 0
),
connectors AS (
  SELECT user_id, cp_id, n_connectors,
         CASE WHEN connector_id <> 1 OR user_id % 7 <> 0 THEN name END AS site_name,
         CASE WHEN user_id % 18 = 17 THEN NULL
              WHEN user_id % 5 = 0 THEN ' ' || lower(pc) ELSE pc END AS postcode,
         latitude, longitude, CAST(connector_id AS VARCHAR) AS connector_id
  FROM (SELECT *, unnest(generate_series(1, n_connectors)) AS connector_id FROM points)
),
cp_ref AS (
  SELECT cp_id,
         arg_min(n_connectors, connector_id) FILTER (WHERE n_connectors IS NOT NULL) AS n_connectors,
         arg_min(site_name, connector_id) FILTER (WHERE site_name IS NOT NULL) AS site_name,
         arg_min(postcode, connector_id) FILTER (WHERE postcode IS NOT NULL) AS postcode,
         arg_min(latitude, connector_id) FILTER (WHERE latitude IS NOT NULL) AS latitude,
         arg_min(longitude, connector_id) FILTER (WHERE longitude IS NOT NULL) AS longitude
  FROM connectors GROUP BY cp_id
)"""


# ---------------------------------------------------------------- lineitem as sessions

def lineitem_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sessions: few distinct start times, many ties, some out of bounds."""
    start = F.col("l_shipdate").cast("timestamp")
    minutes = F.col("l_quantity") * 30
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("cp_id"),
        F.col("l_linenumber").cast("string").alias("connector"),
        start.alias("start_time"),
        F.timestamp_micros(F.unix_micros(start) + (minutes * 60).cast("long") * 1000000).alias("end_time"),
        minutes.alias("duration_minutes"),
        (F.col("l_quantity") * 8).alias("consumption_kwh"),
        F.col("l_extendedprice").alias("amount"),
        F.concat(F.lit("items_"), (F.col("l_orderkey") % 12).cast("string"), F.lit(".csv")).alias("source_file"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    )


LINEITEM_SESSIONS_SQL = """
items AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS cp_id, CAST(l_linenumber AS VARCHAR) AS connector,
         l_shipdate AS start_time,
         l_shipdate + to_seconds(CAST(l_quantity * 30 * 60 AS BIGINT)) AS end_time,
         l_quantity * 30 AS duration_minutes, l_quantity * 8 AS consumption_kwh,
         l_extendedprice AS amount,
         'items_' || CAST(l_orderkey % 12 AS VARCHAR) || '.csv' AS source_file,
         l_orderkey, l_partkey, l_suppkey, l_linenumber
  FROM lineitem
)"""
