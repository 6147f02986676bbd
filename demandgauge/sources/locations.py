"""Location snapshots: choosing one, reading its envelope, counting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as K, schemas
from .tables import require_min_rows


def latest_path(files: DataFrame, prefix: str = K.SNAPSHOT_PREFIX) -> DataFrame:
    """A5: one row with the greatest path among the snapshot files of a listing (path, file_name)."""
    named = F.col("file_name").startswith(prefix) & F.col("file_name").endswith(K.SNAPSHOT_SUFFIX)
    return files.where(named).agg(F.max("path").alias("path"))


def latest_snapshot(files: DataFrame, prefix: str = K.SNAPSHOT_PREFIX) -> str:
    """A5: the path itself; an error when there is no snapshot."""
    path = latest_path(files, prefix).first()[0]
    if path is None:
        raise FileNotFoundError(f"no snapshot named {prefix}*{K.SNAPSHOT_SUFFIX}")
    return path


def snapshot_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the snapshot folder (path, file_name); contents are not read."""
    listed = spark.read.format("binaryFile").load(folder).select("path")
    return listed.withColumn("file_name", F.substring_index("path", "/", -1))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The envelope, one row per snapshot file, with a fixed schema (no inference pass)."""
    return spark.read.schema(schemas.SNAPSHOT).option("multiLine", True).json(path)


def locations(snapshot: DataFrame) -> DataFrame:
    """One row per location with its position in the feed (``loc_no``)."""
    return snapshot.select(F.posexplode("data").alias("loc_no", "location")).select("loc_no", "location.*")


def require_complete(locs: DataFrame, at_least: int = K.MIN_LOCATIONS) -> DataFrame:
    """Raise when a feed holds too few locations to be trusted."""
    return require_min_rows(locs, at_least, "locations")


def snapshot_counts(locs: DataFrame) -> DataFrame:
    """Number of locations and of the EVSEs they list."""
    listed = F.coalesce(F.size(F.coalesce("evses", F.array().cast(schemas.LOCATION["evses"].dataType))), F.lit(0))
    return locs.agg(F.count(F.lit(1)).alias("location_count"),
                    F.coalesce(F.sum(listed), F.lit(0)).alias("evse_count"))
