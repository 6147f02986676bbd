"""Queries on nested locations: every order becomes one location of the feed."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, functions as F

from demandgauge import constants as K, schemas
from demandgauge.functions.text import power_type as power_of
from demandgauge.operators import connectors as D
from demandgauge.session import working_folder
from demandgauge.sources import locations as L

from . import inputs as I

POWER_CODES = ["AC_1_PHASE", "AC_3_PHASE", "DC", "CCS"]


def locations(spark, d) -> DataFrame:
    """Orders as nested feed records."""
    k = F.col("o_orderkey")
    codes = F.array(*[F.lit(c) for c in POWER_CODES], F.lit(None).cast("string"))

    def evse(i):
        def connector(j):
            return F.struct(
                F.when((k + i + j) % 19 != 0, j.cast("string")).alias("id"),
                F.element_at(codes, ((k + i + j) % 5 + 1).cast("int")).alias("power_type"),
                F.when((k + j) % 8 != 0, ((k + j) % 7 * 11).cast("string")).alias("max_charge_rate"),
            )
        n = (k + i) % 4
        return F.struct(
            F.when((k + i) % 11 != 0, F.concat(F.lit("cp"), F.floor((k + i) / 4).cast("string"))).alias("id"),
            F.when(k % 2 == 0, "AVAILABLE").otherwise("CHARGING").alias("status"),
            F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("long")), connector)).alias("connectors"),
        )

    record = F.struct(
        F.concat(F.lit("Location "), k.cast("string")).alias("name"),
        F.concat((k % 100).cast("string"), F.lit(" Main Road")).alias("address"),
        F.when(k % 9 != 0, F.concat(F.lit("Town "), (k % 30).cast("string"))).alias("city"),
        F.when(k % 7 != 0, F.concat(F.lit("EH"), (k % 20).cast("string"), F.lit(" 1AB"))).alias("postal_code"),
        F.when(k % 13 != 0, F.struct(
            F.when(k % 17 == 0, "north").otherwise(F.concat((k % 5 + 55).cast("string"), F.lit(".5"))).alias("latitude"),
            F.concat(F.lit("-"), (k % 6 + 1).cast("string"), F.lit(".25")).alias("longitude"),
        )).alias("coordinates"),
        F.when(k % 23 != 0, F.transform(F.sequence(F.lit(0).cast("long"), k % 3), evse)).alias("evses"),
    )
    return I.table(spark, d, "orders").select(k.alias("loc_no"), F.inline(F.array(record)))


# The same feed unfolded: locations, their EVSEs, their connectors, with the usable ones in `flat`.
FEED_SQL = """
locs AS (
  SELECT o_orderkey AS k, 'Location ' || o_orderkey AS site_name, (o_orderkey % 100) || ' Main Road' AS address,
         CASE WHEN o_orderkey % 9 <> 0 THEN 'Town ' || (o_orderkey % 30) END AS city,
         CASE WHEN o_orderkey % 7 <> 0 THEN 'EH' || (o_orderkey % 20) || ' 1AB' END AS postcode,
         CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 THEN (o_orderkey % 5 + 55) + 0.5::DOUBLE END AS latitude,
         CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 THEN -((o_orderkey % 6 + 1) + 0.25::DOUBLE) END AS longitude,
         o_orderkey % 23 <> 0 AS has_evses
  FROM orders
),
evses AS (
  SELECT *, CASE WHEN (k + i) % 11 <> 0 THEN 'cp' || ((k + i) // 4) END AS cp_id,
         CASE WHEN k % 2 = 0 THEN 'AVAILABLE' ELSE 'CHARGING' END AS network_status, (k + i) % 4 AS n
  FROM (SELECT *, unnest(generate_series(0, k % 3)) AS i FROM locs WHERE has_evses)
),
conns AS (
  SELECT *, CASE WHEN (k + i + j) % 19 <> 0 THEN CAST(j AS VARCHAR) END AS connector_id,
         ['AC_1_PHASE', 'AC_3_PHASE', 'DC', 'CCS', NULL][CAST((k + i + j) % 5 + 1 AS INTEGER)] AS power_code,
         CASE WHEN (k + j) % 8 <> 0 THEN ((k + j) % 7 * 11)::DOUBLE END AS max_charge_rate_kw
  FROM (SELECT *, unnest(generate_series(1, n)) AS j FROM evses WHERE n > 0)
),
flat AS (
  SELECT *, CASE WHEN power_code LIKE 'AC_%' THEN 'AC' ELSE power_code END AS connector_type
  FROM conns WHERE latitude IS NOT NULL AND cp_id IS NOT NULL AND connector_id IS NOT NULL
),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cp_id, connector_id ORDER BY k, i, j) AS rn FROM flat)
  WHERE rn = 1
),
counted AS (SELECT *, CAST(count(*) OVER (PARTITION BY cp_id) AS INTEGER) AS n_connectors FROM firsts)"""
_WITH = f"WITH {FEED_SQL}"
_FLAT = ["cp_id", "connector_id", "site_name", "address", "city", "postcode", "latitude", "longitude",
         "connector_type", "max_charge_rate_kw", "network_status"]
FIXED_POSTCODES = {"cp5": "G1 1AA", "cp100": "AB1 2CD"}
FIXED_PLACES = {"cp7": (57.25, -2.5)}


LOCATIONS_PER_FILE = 1000


def read_locations(spark, d):
    """The feed as snapshot files of at most 1000 locations each, read back through the file source."""
    record = F.struct("name", "address", "city", "postal_code", "coordinates", "evses")
    chunk = F.floor(F.col("loc_no") / LOCATIONS_PER_FILE)
    envelopes = locations(spark, d).groupBy(chunk.alias("chunk")).agg(
        F.count(F.lit(1)).alias("location_count"), F.sort_array(F.collect_list(F.struct("loc_no", record.alias("r")))).alias("rs"))
    text = F.to_json(F.struct("location_count", F.transform("rs", lambda x: x["r"]).alias("data")))
    folder = os.path.join(working_folder(spark), f"snapshots-{uuid.uuid4().hex}")
    envelopes.select("chunk", text.alias("value")).write.partitionBy("chunk").text(folder)
    return L.locations(L.read_snapshot(spark, folder)).select(
        "loc_no", F.col("name").alias("site_name"), "city", F.col("coordinates.latitude").alias("latitude_text"),
        F.size(F.coalesce("evses", F.array().cast(schemas.LOCATION["evses"].dataType))).alias("n_evses"))


def latest_snapshot(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    name = F.concat(F.when(F.col("o_orderstatus") == "F", K.SNAPSHOT_PREFIX).otherwise("other_"), day, F.lit(".json"))
    files = I.table(spark, d, "orders").select(name.alias("file_name"), F.concat(F.lit("/feed/"), name).alias("path"))
    return L.latest_path(files)


def flatten_connectors(spark, d):
    return D.flatten_connectors(locations(spark, d)).select(*_FLAT, F.col("feed_order.loc_no").alias("loc_no"))


def dedup_connectors(spark, d):
    return D.dedup_connectors(D.flatten_connectors(locations(spark, d))).select(*_FLAT)


def n_connectors(spark, d):
    rows = D.with_n_connectors(D.dedup_connectors(D.flatten_connectors(locations(spark, d))))
    return rows.select("cp_id", "connector_id", "n_connectors")


def power_type(spark, d):
    k = F.col("o_orderkey")
    codes = F.array(*[F.lit(c) for c in POWER_CODES + ["AC_2_PHASE"]], F.lit(None).cast("string"))
    code = F.element_at(codes, (k % 6 + 1).cast("int"))
    return I.table(spark, d, "orders").select("o_orderkey", power_of(code).alias("power_type"))


def overrides(spark, d):
    rows = D.flatten_connectors(locations(spark, d)).select("cp_id", "connector_id", "postcode", "latitude", "longitude")
    return D.apply_overrides(rows, FIXED_POSTCODES, FIXED_PLACES)


def overrides_by_table(spark, d):
    """Corrections as tables: one row per customer key that names a charge point."""
    c = I.table(spark, d, "customer").where("c_custkey % 3 = 0").withColumn(
        "cp_id", F.concat(F.lit("cp"), F.col("c_custkey").cast("string")))
    postcodes = c.select("cp_id", F.concat(F.lit("ZE"), (F.col("c_custkey") % 3 + 1).cast("string"), F.lit(" 9ZZ")).alias("postcode"))
    places = c.where("c_custkey % 2 = 0").select(
        "cp_id", (F.col("c_custkey") % 50 + 10).cast("double").alias("latitude"), F.lit(-1.5).alias("longitude"))
    rows = D.flatten_connectors(locations(spark, d)).select("cp_id", "connector_id", "postcode", "latitude", "longitude")
    return D.apply_overrides(rows, postcodes, places)


def snapshot_counts(spark, d):
    return L.snapshot_counts(locations(spark, d))


def skip_counts(spark, d):
    return D.skip_counts(locations(spark, d))


def charge_points(spark, d):
    return D.charge_points(locations(spark, d), "snapshot.json", postcodes=FIXED_POSTCODES, coordinates=FIXED_PLACES).select(
        *_FLAT, "n_connectors", "postcode_source", "coord_source", "source_snapshot")


QUERIES = {
    "read_locations": read_locations,
    "latest_snapshot": latest_snapshot,
    "flatten_connectors": flatten_connectors,
    "dedup_connectors": dedup_connectors,
    "n_connectors": n_connectors,
    "power_type": power_type,
    "overrides": overrides,
    "overrides_by_table": overrides_by_table,
    "snapshot_counts": snapshot_counts,
    "skip_counts": skip_counts,
    "charge_points": charge_points,
}

_COLS = ", ".join(_FLAT)
_PC_CASE = "CASE cp_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FIXED_POSTCODES.items()) + " END"
_LAT_CASE = "CASE cp_id " + " ".join(f"WHEN '{k}' THEN {v[0]}::DOUBLE" for k, v in FIXED_PLACES.items()) + " END"
_LON_CASE = "CASE cp_id " + " ".join(f"WHEN '{k}' THEN ({v[1]})::DOUBLE" for k, v in FIXED_PLACES.items()) + " END"
_FIXED = f"""coalesce({_PC_CASE}, postcode) AS postcode,
       CASE WHEN {_PC_CASE} IS NOT NULL THEN 'override' ELSE 'feed' END AS postcode_source,
       coalesce({_LAT_CASE}, latitude) AS latitude, coalesce({_LON_CASE}, longitude) AS longitude,
       CASE WHEN {_LAT_CASE} IS NOT NULL THEN 'override' ELSE 'feed' END AS coord_source"""

ORACLE = {
    "read_locations": _WITH + f"""
SELECT CAST(k % {LOCATIONS_PER_FILE} AS INTEGER) AS loc_no, site_name, city,
       CASE WHEN k % 13 <> 0 THEN CASE WHEN k % 17 = 0 THEN 'north' ELSE (k % 5 + 55) || '.5' END END AS latitude_text,
       CAST(CASE WHEN has_evses THEN k % 3 + 1 ELSE 0 END AS INTEGER) AS n_evses
FROM locs""",
    "latest_snapshot": f"""
SELECT '/feed/{K.SNAPSHOT_PREFIX}' || max(strftime(o_orderdate, '%Y-%m-%d')) || '.json' AS path
FROM orders WHERE o_orderstatus = 'F'""",
    "flatten_connectors": _WITH + f" SELECT {_COLS}, k AS loc_no FROM flat",
    "dedup_connectors": _WITH + f" SELECT {_COLS} FROM firsts",
    "n_connectors": _WITH + " SELECT cp_id, connector_id, n_connectors FROM counted",
    "power_type": """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'AC' WHEN 1 THEN 'AC' WHEN 2 THEN 'DC' WHEN 3 THEN 'CCS'
                   WHEN 4 THEN 'AC' END AS power_type FROM orders""",
    "overrides": _WITH + f" SELECT cp_id, connector_id, {_FIXED} FROM flat",
    "overrides_by_table": _WITH + """,
fixes AS (
  SELECT 'cp' || c_custkey AS cp_id, 'ZE' || (c_custkey % 3 + 1) || ' 9ZZ' AS pc,
         CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 50 + 10)::DOUBLE END AS la,
         CASE WHEN c_custkey % 2 = 0 THEN (-1.5)::DOUBLE END AS lo
  FROM customer WHERE c_custkey % 3 = 0
)
SELECT cp_id, connector_id, coalesce(pc, postcode) AS postcode,
       CASE WHEN pc IS NOT NULL THEN 'override' ELSE 'feed' END AS postcode_source,
       coalesce(la, latitude) AS latitude, coalesce(lo, longitude) AS longitude,
       CASE WHEN la IS NOT NULL THEN 'override' ELSE 'feed' END AS coord_source
FROM flat LEFT JOIN fixes USING (cp_id)""",
    "snapshot_counts": _WITH + """
SELECT (SELECT count(*) FROM locs) AS location_count, (SELECT count(*) FROM evses) AS evse_count""",
    "skip_counts": _WITH + """,
s AS (
  SELECT (SELECT count(*) FROM locs WHERE latitude IS NULL) AS locations,
         (SELECT count(*) FROM evses WHERE latitude IS NOT NULL AND (cp_id IS NULL OR n = 0)) AS evses,
         (SELECT count(*) FROM conns WHERE latitude IS NOT NULL AND cp_id IS NOT NULL AND connector_id IS NULL) AS connectors
)
SELECT *, locations + evses + connectors AS skipped FROM s""",
    "charge_points": _WITH + f"""
SELECT cp_id, connector_id, site_name, address, city, connector_type, max_charge_rate_kw, network_status,
       n_connectors, 'snapshot.json' AS source_snapshot, {_FIXED} FROM counted""",
}
