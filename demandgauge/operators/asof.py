"""As-of join: the last row of the other table at or before each time, per key.

Both tables are merged in order of time and the last known value is carried along, as the
sweep carries its sum: time is cut into slices; per (key, slice) the last value is an aggregate, a running
``last`` over the slices of a key carries it on, and every slice opens with what is carried into it.
Inside a slice a running ``last`` then gives each row its value.  Nothing is joined, and a key with any
share of the rows is spread over its slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICE_SECONDS = 86400
_OPENING, _VALUE, _ROW = range(3)


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tie: list[str] | None = None,
    tolerance_seconds: int | None = None, slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """All rows of ``left`` with the columns of the last row of ``right`` at or before their time, else NULL.

    Of several right rows at one time the one with the greatest ``tie`` columns counts (default: all its columns
    in order).  ``tolerance_seconds``: older rows do not count.  Left rows with a NULL key or time stay, without
    a match; right rows with one are ignored.  Apart from the keys, column names must differ.
    """
    values = [c for c in right.columns if c not in keys]
    common = set(left.columns) & set(values)
    if common:
        raise ValueError(f"columns on both sides: {sorted(common)}")
    width = slice_seconds * 1_000_000
    known = (
        right.na.drop(subset=[*keys, right_time]).withColumn("_us", micros(right_time))
        .groupBy(*keys, "_us").agg(F.max_by(F.struct(*values), F.struct(*(tie or values))).alias("_best"))
        .select(*keys, "_us", F.struct("_us", "_best.*").alias("_value"))
    )
    asked = left.withColumn("_us", micros(left_time))
    lacking = F.col("_us").isNull()
    for k in keys:
        lacking = lacking | F.col(k).isNull()
    placed = lambda df, side: df.withColumns({"_side": F.lit(side), "_slice": slice_of(F.col("_us"), width)})
    rows, changes = placed(asked.where(~lacking), _ROW), placed(known, _VALUE)
    cut = [*keys, "_slice"]
    lasts = (
        changes.select(*cut, "_us", "_value").unionByName(rows.select(*cut).distinct(), allowMissingColumns=True)
        .groupBy(*cut).agg(F.max_by("_value", "_us").alias("_last"))
    )
    over_slices = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    openings = lasts.select(*cut, F.last("_last", ignorenulls=True).over(over_slices).alias("_value")).where("_value IS NOT NULL").withColumns(
        {"_us": F.col("_slice") * width, "_side": F.lit(_OPENING)})
    in_slice = Window.partitionBy(*cut).orderBy("_us", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = rows.unionByName(changes, allowMissingColumns=True).unionByName(openings, allowMissingColumns=True)
    found = merged.withColumn("_value", F.last("_value", ignorenulls=True).over(in_slice)).where(F.col("_side") == _ROW)
    near = F.lit(True) if tolerance_seconds is None else F.col("_us") - F.col("_value._us") <= tolerance_seconds * 1_000_000
    matched = found.select(*left.columns, *[F.when(near, F.col("_value")[c]).alias(c) for c in values])
    return matched.unionByName(asked.where(lacking).select(*left.columns), allowMissingColumns=True)


def micros(time: str) -> Column:
    """Microseconds since 1970."""
    return F.unix_micros(F.col(time).cast("timestamp"))


def slice_of(us: Column, width: int) -> Column:
    """The slice of ``width`` that a time falls into, both in microseconds (or both in seconds)."""
    return F.call_function("div", us - F.pmod(us, F.lit(width)), F.lit(width).cast("bigint"))
