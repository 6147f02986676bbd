"""Schemas of the tables the pipelines read and write."""

from pyspark.sql import types as T

SESSIONS = T.StructType([
    T.StructField("site_name", T.StringType(), True),
    T.StructField("cp_id", T.StringType(), False),
    T.StructField("connector_type", T.StringType(), True),
    T.StructField("connector", T.StringType(), False),
    T.StructField("currency", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("consumption_kwh", T.DoubleType(), False),
    T.StructField("duration_minutes", T.DoubleType(), False),
    T.StructField("start_time", T.TimestampType(), False),
    T.StructField("end_time", T.TimestampType(), True),
    T.StructField("source_file", T.StringType(), False),
    T.StructField("ingested_at", T.TimestampType(), False),
    T.StructField("year_month", T.StringType(), False),
])

CHARGE_POINTS = T.StructType([
    T.StructField("cp_id", T.StringType(), False),
    T.StructField("connector_id", T.StringType(), False),
    T.StructField("n_connectors", T.IntegerType(), False),
    T.StructField("site_name", T.StringType(), True),
    T.StructField("address", T.StringType(), True),
    T.StructField("city", T.StringType(), True),
    T.StructField("postcode", T.StringType(), True),
    T.StructField("postcode_source", T.StringType(), True),
    T.StructField("latitude", T.DoubleType(), True),
    T.StructField("longitude", T.DoubleType(), True),
    T.StructField("coord_source", T.StringType(), True),
    T.StructField("connector_type", T.StringType(), True),
    T.StructField("max_charge_rate_kw", T.DoubleType(), True),
    T.StructField("network_status", T.StringType(), True),
    T.StructField("source_snapshot", T.StringType(), False),
    T.StructField("ingested_at", T.TimestampType(), False),
])

PRESSURE = T.StructType([
    T.StructField("cp_id", T.StringType()),
    T.StructField("pressure_rank", T.IntegerType()),
    T.StructField("pressure_score", T.DoubleType()),
    T.StructField("saturation_rate", T.DoubleType()),
    T.StructField("utilisation", T.DoubleType()),
    T.StructField("saturated_hours", T.DoubleType()),
    T.StructField("cp_available_hours", T.DoubleType()),
    T.StructField("occupied_hours", T.DoubleType()),
    T.StructField("available_connector_hours", T.DoubleType()),
    T.StructField("total_sessions", T.LongType()),
    T.StructField("total_energy_kwh", T.DoubleType()),
    T.StructField("total_revenue", T.DoubleType()),
    T.StructField("revenue_per_connector", T.DoubleType()),
    T.StructField("n_connectors", T.IntegerType()),
    T.StructField("single_connector", T.BooleanType()),
    T.StructField("site_name", T.StringType()),
    T.StructField("postcode", T.StringType()),
    T.StructField("postcode_area", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("ingested_at", T.TimestampType()),
])

FINDINGS = T.StructType([
    T.StructField("check_name", T.StringType(), False),
    T.StructField("entity_id", T.StringType(), False),
    T.StructField("message", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("detected_at", T.TimestampType()),
    T.StructField("resolved_at", T.TimestampType()),
])

FINDING_DETAILS = T.StructType([
    T.StructField("verdict", T.StringType()),
    T.StructField("site_name", T.StringType()),
    T.StructField("feed_postcode", T.StringType()),
    T.StructField("feed_area", T.StringType()),
    T.StructField("coord_postcode", T.StringType()),
    T.StructField("coord_area", T.StringType()),
])

CONNECTOR = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("power_type", T.StringType()),
    T.StructField("max_charge_rate", T.StringType()),
])
EVSE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("connectors", T.ArrayType(CONNECTOR)),
])
LOCATION = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("postal_code", T.StringType()),
    T.StructField("coordinates", T.StructType([
        T.StructField("latitude", T.StringType()),
        T.StructField("longitude", T.StringType()),
    ])),
    T.StructField("evses", T.ArrayType(EVSE)),
])
SNAPSHOT = T.StructType([
    T.StructField("harvested_at", T.StringType()),
    T.StructField("feed_url", T.StringType()),
    T.StructField("location_count", T.LongType()),
    T.StructField("evse_count", T.LongType()),
    T.StructField("status_code", T.LongType()),
    T.StructField("data", T.ArrayType(LOCATION)),
])


def required_columns(schema: T.StructType) -> list[str]:
    """Names of the columns a row must fill to be kept."""
    return [f.name for f in schema.fields if not f.nullable]
