"""Event-time work on a stream of sessions: windows, duplicates and joins, each with state that a watermark bounds.

Every function takes a DataFrame that may be a stream or a table; a table has no late rows, so its result is what
the stream comes to.  The watermark is the latest event time seen so far less the ``late`` allowance; it moves
between batches.  State is kept per key by Spark and expires by the watermark, so its size follows the
allowance, not the length of the stream.  A key with very many rows costs one row of state per window, copy or side;
windows are pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def tumbling(width: str, time: str = "start_time") -> Column:
    """Windows one after another."""
    return F.window(time, width)


def sliding(width: str, every: str, time: str = "start_time") -> Column:
    """Overlapping windows; a row belongs to width / every of them."""
    return F.window(time, width, every)


def inactivity(gap: str, time: str = "start_time") -> Column:
    """Windows that last until no row has come for ``gap``."""
    return F.session_window(time, gap)


def usage_windows(sessions: DataFrame, window: Column, keys: list[str], late: str, time: str = "start_time") -> DataFrame:
    """(window_start, window_end, keys, sessions, energy_kwh, occupied_minutes) per window and key.

    As a stream each window comes once, when the watermark has passed its end.  A row is late, and left out, for a window
    that ends at or before the watermark of the batches before its own; NULL times belong to no window, NULL keys
    are one key, NULL measures add nothing.
    """
    counted = sessions.where(F.col(time).isNotNull()).withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("consumption_kwh"), F.lit(0.0)).alias("energy_kwh"),
        F.coalesce(F.sum("duration_minutes"), F.lit(0.0)).alias("occupied_minutes"))
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "sessions", "energy_kwh", "occupied_minutes")


def first_copies(sessions: DataFrame, keys: list[str], late: str, time: str = "start_time") -> DataFrame:
    """C13 on a stream: a session comes through once, however often its file or row is delivered.

    The key is remembered from the first copy until the watermark is ``late`` beyond its time; copies later than that
    are below the watermark and go too.  Copies in different batches: the earliest stays; within one batch any
    one stays, so rows of one key that differ elsewhere should be reduced by ``dedup_first`` per batch.  NULLs in keys are equal.
    """
    return sessions.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def with_status(sessions: DataFrame, statuses: DataFrame, keys: list[str], before: str, after: str, late: str,
                how: str = "leftOuter", time: str = "start_time", status_time: str = "status_time") -> DataFrame:
    """Sessions with the status events of their key from ``before`` their time until ``after`` it.

    Both sides wait in state until no match can come: a session until the watermark passes its time + ``after``, a status
    until it passes its time + ``before``.  With ``leftOuter``, a session without any status comes once, then.
    Rows with a NULL key or time match nothing.  Other columns of both sides must differ in name.
    """
    left = sessions.withWatermark(time, late)
    right = statuses.select(*[F.col(c).alias(f"_of_{c}") if c in keys else F.col(c) for c in statuses.columns]).withWatermark(status_time, late)
    on = F.col(status_time).between(F.col(time) - F.expr(f"INTERVAL {before}"), F.col(time) + F.expr(f"INTERVAL {after}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_of_{k}"))
    return left.join(right, on, how).drop(*[f"_of_{k}" for k in keys])


def arrivals(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they come into a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def append_available(results: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Work through what has arrived since the last call, append what became final to ``table``, and stop.

    The checkpoint holds offsets, watermark and state, so the next call goes on where this one ended, also after a failure;
    readers of ``table`` see each batch once.
    """
    return (
        results.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(table)
    )


def rows_too_late(query: StreamingQuery) -> int:
    """Rows (per window) that the batches of this run left out as late."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def rows_in_state(query: StreamingQuery) -> int:
    """Rows of state after the last batch."""
    return sum(int(op.numRowsTotal) for op in query.lastProgress.stateOperators) if query.lastProgress else 0
