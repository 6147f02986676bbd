"""Stored tables: scans, partitioned appends, overwrites, gates and idempotent seeds."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as K


def scan(spark: SparkSession, path: str, columns: list[str] | None = None,
         months: list[str] | None = None) -> DataFrame:
    """A stored table; ``months`` prunes the partitions of the session table."""
    df = spark.read.parquet(path)
    if months is not None:
        df = df.where(F.col("year_month").isin(months))
    return df.select(*columns) if columns else df


def scan_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, None when nothing has been written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_sessions(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write sessions partitioned by month.

    The rebalance hint lets Spark split a month that holds much of the data over several
    tasks and merge small ones, so neither one huge task nor many tiny files result.
    """
    df.hint("rebalance", "year_month").write.partitionBy("year_month").mode(mode).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Replace a table and its schema.  ``df`` must not read from ``path``."""
    df.write.mode("overwrite").parquet(path)


def require_min_rows(df: DataFrame, at_least: int, what: str = "rows") -> DataFrame:
    """Raise unless ``df`` has enough rows; checked before anything is written.

    Give it a written table (see ``materialise``), whose count comes from file footers.
    """
    found = df.count()
    if found < at_least:
        raise ValueError(f"only {found} {what}, expected at least {at_least}; nothing was written")
    return df


def require_nonempty(df: DataFrame, what: str) -> DataFrame:
    """G1: raise when a reference list is empty."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def missing_from(seed: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Seed rows whose key the target does not hold yet."""
    return seed.join(target.select(key), key, "left_anti")


def merge_insert_missing(spark: SparkSession, seed: DataFrame, path: str, key: str) -> None:
    """Append the missing seed rows; running it again adds nothing."""
    target = scan_if_exists(spark, path)
    (seed if target is None else missing_from(seed, target, key)).write.mode("append").parquet(path)


def postcode_areas(spark: SparkSession) -> DataFrame:
    """The allowlist of postcode areas as a literal table."""
    rows = ", ".join(f"('{code}', '{name}')" for code, name in K.POSTCODE_AREAS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v(area_code, area_name)")
