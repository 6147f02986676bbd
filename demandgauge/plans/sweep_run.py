"""The sweep kept up to date (E8 with A16): a run computes only the slices of time that its new sessions touch.

Three append-only tables, one folder per run, all additive over runs:

- ``changes`` (period, cp_id, slice, second, change), partitioned by period (a year of slices) and sorted by slice;
- ``nets`` (cp_id, slice, net), the sum of the changes of a slice, from which concurrency at the start of a slice follows;
- ``levels`` (cp_id, slice, running, seconds): time added to, or with a minus taken from, each level of concurrency.

A session touches the slices from its start to its end; outside them neither changes nor the concurrency carried into
a slice differ.  For those slices concurrency without and with the new sessions is summed up side by side, from the
stored changes of just these slices; where the two differ, the run stores what is added and taken.  Reading is one sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.asof import slice_of
from ..operators.sweep import SLICE_SECONDS, concurrency_changes
from ..session import materialise

#: Slices per period, the partition of the stored changes.
PERIOD = 13
_CHANGES = "cp_id string, slice bigint, second bigint, change bigint, period bigint"
_NETS = "cp_id string, slice bigint, net bigint"
_LEVELS = "cp_id string, slice bigint, running bigint, seconds bigint"


def add_sessions(spark: SparkSession, sessions: DataFrame, path: str, run: int) -> None:
    """Take in new ``sessions`` (cp_id, start_time, end_time) as run number ``run``.

    Runs count up from 0.  A run that failed is repeated under its number and replaces what it has left; sessions that an earlier run took in
    are counted again, so files must come once (A2, S1).  Sessions without start or end, or that do
    not last a second, change nothing.
    """
    start, end = F.unix_seconds("start_time"), F.unix_seconds("end_time")
    lasting = sessions.where(end > start).select("cp_id", "start_time", "end_time")
    cut = ["cp_id", "slice"]
    slice_at = lambda c: slice_of(c, SLICE_SECONDS)
    touched = materialise(
        lasting.select("cp_id", F.explode(F.sequence(slice_at(start), slice_at(end))).alias("slice")).distinct(), "touched")
    new = concurrency_changes(lasting).where("change <> 0").select("cp_id", slice_at(F.col("second")).alias("slice"), "second", "change")
    new.withColumn("period", _period()).hint("rebalance", "period").sortWithinPartitions("period", "slice").write.mode(
        "overwrite").partitionBy("period").parquet(f"{path}/changes/run={run}")
    new = _run(spark, path, "changes", _CHANGES, [run]).drop("period")
    new.groupBy(*cut).agg(F.sum("change").alias("net")).where("net <> 0").write.mode("overwrite").parquet(f"{path}/nets/run={run}")
    before = list(range(run))
    # The period is in the join so that only the files of touched periods are read.
    old = _run(spark, path, "changes", _CHANGES, before).join(
        touched.withColumn("period", _period()), ["period", *cut], "left_semi").drop("period")
    nets = _run(spark, path, "nets", _NETS, before).withColumn("old", F.col("net")).unionByName(
        _run(spark, path, "nets", _NETS, [run]).withColumn("old", F.lit(0).cast("bigint")))
    changes = old.withColumn("old", F.col("change")).unionByName(new.withColumn("old", F.lit(0).cast("bigint")))
    _difference(changes, _carried(nets, touched)).write.mode("overwrite").parquet(f"{path}/levels/run={run}")


def stored_levels(spark: SparkSession, path: str, runs: int) -> DataFrame:
    """(cp_id, running, seconds) of the first ``runs`` runs: total time of each point at each concurrency above 0."""
    levels = _run(spark, path, "levels", _LEVELS, list(range(runs)))
    return levels.groupBy("cp_id", "running").agg(F.sum("seconds").alias("seconds")).where("seconds <> 0")


def _period() -> Column:
    return F.expr(f"(slice - pmod(slice, {PERIOD})) div {PERIOD}")


def _run(spark: SparkSession, path: str, table: str, schema: str, runs: list[int]) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{table}").parquet(
        *[f"{path}/{table}/run={r}" for r in runs]).drop("run")


def _carried(nets: DataFrame, touched: DataFrame) -> DataFrame:
    """(cp_id, slice, old, carried): concurrency at the start of each touched slice, without and with the new sessions."""
    points, none = touched.select("cp_id").distinct(), F.lit(None).cast("bigint")
    both = nets.join(points, "cp_id", "left_semi").unionByName(touched.withColumns({"net": none, "old": none}))
    summed = both.groupBy("cp_id", "slice").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("old", "net")], F.count_if(F.col("net").isNull()).alias("asked"))
    earlier = Window.partitionBy("cp_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    return summed.select("cp_id", "slice", "asked", upto("old").alias("old"), upto("net").alias("carried")).where("asked > 0").drop("asked")


def _difference(changes: DataFrame, carried: DataFrame) -> DataFrame:
    """(cp_id, slice, running, seconds): time that each level gains or loses inside each slice of ``carried``.

    ``changes`` has the change of a second (``change``) and what of it was there before (``old``).
    """
    cut = ["cp_id", "slice"]
    edges = carried.select(*cut, F.inline(F.array(
        F.struct((F.col("slice") * SLICE_SECONDS).alias("second"), F.col("old"), F.col("carried").alias("change")),
        F.struct(((F.col("slice") + 1) * SLICE_SECONDS).alias("second"), F.lit(0).cast("bigint").alias("old"), F.lit(0).cast("bigint").alias("change")))))
    # Dealt by slice once: the sums, the windows and the last sums below all find their rows together.
    summed = changes.select(*cut, "second", "old", "change").unionByName(edges).repartition(*cut).groupBy(*cut, "second").agg(
        F.sum("old").alias("old"), F.sum("change").alias("change"))
    in_slice = Window.partitionBy(*cut).orderBy("second")
    running = summed.select(*cut, F.sum("old").over(in_slice).alias("old"), F.sum("change").over(in_slice).alias("now"),
                            (F.lead("second").over(in_slice) - F.col("second")).alias("seconds"))
    return running.where("old <> now AND seconds > 0").select(*cut, F.inline(F.array(
        F.struct(F.col("now").alias("running"), "seconds"), F.struct(F.col("old").alias("running"), (-F.col("seconds")).alias("seconds"))))).where(
        "running > 0").groupBy(*cut, "running").agg(F.sum("seconds").alias("seconds")).where("seconds <> 0")
