"""Newest location snapshot to the stored connector table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from .. import constants as K
from ..operators.connectors import charge_points
from ..session import materialise
from ..sources import locations as L, tables


def run_locations(spark: SparkSession, folder: str, target: str, min_connectors: int = K.MIN_CONNECTORS,
                  min_locations: int = K.MIN_LOCATIONS, now: Column | None = None,
                  postcodes=None, coordinates=None) -> DataFrame:
    """Flatten the newest snapshot and store it, unless it looks incomplete."""
    path = L.latest_snapshot(L.snapshot_files(spark, folder))
    locs = L.locations(L.read_snapshot(spark, path))
    if min_locations:
        L.require_complete(locs, min_locations)
    rows = charge_points(locs, path.rsplit("/", 1)[-1], now, postcodes, coordinates)
    ready = materialise(rows, "charge_points")
    tables.require_min_rows(ready, min_connectors, "connectors")
    tables.write_table(ready, target)
    return tables.scan(spark, target)
