"""Concurrency over time: hours in which all connectors of a point are busy.

A sweep over start and end events, made of aggregates and bounded windows:

1. every session becomes +1 at its start second and -1 at its end second;
2. changes are summed per (point, second) before any ordering, so the order of ties
   does not matter and a busy second is one row however many sessions share it;
3. time is cut into slices of four weeks; per (point, slice) the net change is carried to
   later slices by a running sum over the slices;
4. every slice gets a row that opens it with the carried concurrency and one that closes it
   where the next slice with changes begins; inside one (point, slice) a running sum then
   gives the concurrency, and the next row ends each stretch.

A slice has 2.4 million seconds, so no window partition grows beyond that with the number
of sessions: one point may hold any share of the data.  Long sessions are not multiplied,
quiet points get few extra rows, and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SLICE_SECONDS = 28 * 86400


def concurrency_changes(sessions: DataFrame) -> DataFrame:
    """(cp_id, slice, second, change): net change of running sessions in each second."""
    start, end = F.unix_seconds("start_time"), F.unix_seconds("end_time")
    steps = sessions.where(start.isNotNull() & end.isNotNull()).select(
        "cp_id", F.explode(F.array(
            F.struct(start.alias("second"), F.lit(1).alias("step")),
            F.struct(end.alias("second"), F.lit(-1).alias("step")),
        )).alias("e"))
    return (
        steps.select("cp_id", F.expr("e.second div %d" % SLICE_SECONDS).alias("slice"), "e.second", "e.step")
        .groupBy("cp_id", "slice", "second")
        .agg(F.sum("step").alias("change"))
    )


def concurrency_levels(sessions: DataFrame) -> DataFrame:
    """(cp_id, running, seconds): concurrency after each change and how long it lasts."""
    changes = concurrency_changes(sessions)
    over_slices = Window.partitionBy("cp_id").orderBy("slice")
    carried = F.coalesce(
        F.sum("net").over(over_slices.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = (
        changes.groupBy("cp_id", "slice")
        .agg(F.sum("change").alias("net"), F.min("second").alias("first_second"))
        .select(
            "cp_id", "slice",
            F.struct(F.col("first_second").alias("second"), carried.alias("change")).alias("opening"),
            F.struct(F.lead("first_second").over(over_slices).alias("second"),
                     F.lit(0).cast("long").alias("change")).alias("closing"),
        )
        .select("cp_id", "slice", F.inline(F.array("opening", "closing")))
        .where(F.col("second").isNotNull())
    )
    # Rows of one second share their running sum (range frame) and add zero-length stretches.
    in_slice = Window.partitionBy("cp_id", "slice").orderBy("second")
    return changes.unionByName(ends).select(
        "cp_id",
        F.sum("change").over(in_slice).alias("running"),
        F.coalesce(F.lead("second").over(in_slice) - F.col("second"), F.lit(0)).alias("seconds"),
    )


def seconds_by_level(sessions: DataFrame) -> DataFrame:
    """(cp_id, running, seconds): total time each point spent at each concurrency."""
    return (
        concurrency_levels(sessions)
        .groupBy("cp_id", "running")
        .agg(F.sum("seconds").alias("seconds"))
    )


def saturated_hours(sessions: DataFrame, capacity: DataFrame) -> DataFrame:
    """(cp_id, saturated_hours), hours with at least ``n_connectors`` running sessions.

    ``sessions``: cp_id, start_time, end_time.  ``capacity``: cp_id, n_connectors, one
    row per point.  Points without capacity rows drop; a capacity of NULL or below 1
    gives 0 hours.  Capacity is joined after the sessions are reduced to time spent per
    concurrency level, so the sessions themselves are never joined.
    """
    busy = (F.col("n_connectors") > 0) & (F.col("running") >= F.col("n_connectors"))
    return (
        seconds_by_level(sessions)
        .join(capacity.select("cp_id", "n_connectors"), "cp_id")
        .groupBy("cp_id")
        .agg((F.sum(F.when(busy, F.col("seconds")).otherwise(0)) / 3600.0).alias("saturated_hours"))
    )
