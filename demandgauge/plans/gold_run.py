"""Stored sessions and connectors to the published pressure index and the site view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..operators.metrics import RunMetrics
from ..operators.pressure import gold, pressure_index
from ..operators.sites import site_view
from ..sources import tables

_SESSION_COLUMNS = [
    "cp_id", "connector", "start_time", "end_time", "duration_minutes", "consumption_kwh", "amount",
]


def run_pressure(spark: SparkSession, sessions_path: str, connectors_path: str, target: str,
                 min_sessions: int = K.MIN_SESSIONS, months: list[str] | None = None,
                 now: Column | None = None, metrics: RunMetrics | None = None) -> DataFrame:
    """Compute and store the index; returns the stored table.

    ``metrics`` receives the number of points before and after the session floor.
    """
    sessions = tables.scan(spark, sessions_path, months=months).select(*_SESSION_COLUMNS)
    index = pressure_index(sessions, tables.scan(spark, connectors_path), min_sessions, metrics=metrics)
    tables.write_table(gold(index, now), target)
    return tables.scan(spark, target)


def unplaced_sessions(sessions: DataFrame, connectors: DataFrame) -> DataFrame:
    """Sessions per charge point without a location; the index leaves them out."""
    counted = sessions.groupBy("cp_id").agg(F.count(F.lit(1)).alias("sessions"))
    return counted.join(connectors.select("cp_id").distinct(), "cp_id", "left_anti")


def stored_site_view(spark: SparkSession, index_path: str) -> DataFrame:
    """Ranked sites from the stored index."""
    return site_view(tables.scan(spark, index_path))
