"""Exact ranks and percentiles over all rows, without a one-task window.

A window ordered by a value but not partitioned moves every row to one task.  The
operators here count distinct values first (ties collapse map-side) and then add up
counts along three nested value ranges: coarse cells of the logarithm, fine cells
inside a coarse cell, and single values inside a fine cell.  Each running sum is
partitioned by the level above it.  A double has 52 mantissa bits, so one fine cell
holds at most a few million different values and one coarse cell about two million fine
cells, whatever the data look like; no window ever sees a whole column.  Only the order
of the cells matters for the result, and ``ln`` never decreases, so the ranks are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

_COARSE = float(2 ** 10)
_FINE = float(2 ** 31)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, value, n_equal): how often each value occurs in each column."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("metric"), _clean(F.col(c)).alias("value")) for c in columns
    ])
    return (
        df.select(F.explode(pairs).alias("p"))
        .groupBy("p.metric", "p.value")
        .agg(F.count(F.lit(1)).alias("n_equal"))
    )


def value_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column and distinct value: rows before it, equal to it, NULL, and in total.

    Ascending order, NULL before everything else.
    """
    value = F.col("value")
    magnitude = F.when(value > 0, F.ln(value)).when(value < 0, -F.ln(-value))
    # The keys are never NULL, so joining on them adds no filters: all three levels read the
    # value counts through one and the same shuffle.
    values = value_counts(df, columns).select(
        "metric", "value", "n_equal",
        F.when(value.isNull(), -2).when(value < 0, -1).when(value > 0, 1).otherwise(0).alias("sign"),
        F.coalesce(F.floor(magnitude * _COARSE), F.lit(0)).alias("coarse"),
        F.coalesce(F.floor(magnitude * _FINE), F.lit(0)).alias("fine"),
    )
    top, mid = ["metric", "sign", "coarse"], ["metric", "sign", "coarse", "fine"]

    coarse = values.groupBy(*top).agg(
        F.sum("n_equal").alias("n"),
        F.sum(F.when(value.isNull(), F.col("n_equal")).otherwise(0)).alias("n_null"),
    )
    whole = Window.partitionBy("metric")
    coarse = coarse.select(
        *top,
        _before("n", ["metric"], ["sign", "coarse"]).alias("before_coarse"),
        F.sum("n").over(whole).alias("n_rows"),
        F.sum("n_null").over(whole).alias("n_null"),
    )
    fine = (
        values.groupBy(*mid).agg(F.sum("n_equal").alias("n"))
        .select(*mid, _before("n", top, ["fine"]).alias("before_fine"))
        .join(coarse, top)
    )
    return (
        values.select(
            *mid, "value", "n_equal", _before("n_equal", mid, ["value"]).alias("before_value")
        )
        .join(fine, mid)
        .select(
            "metric", "value", "n_equal",
            (F.col("before_coarse") + F.col("before_fine") + F.col("before_value")).alias("n_before"),
            "n_null", "n_rows",
        )
    )


def with_percentiles(
    df: DataFrame,
    cume: dict[str, str] | None = None,
    average: dict[str, str] | None = None,
    descending: dict[str, str] | None = None,
) -> DataFrame:
    """Add rank columns; each argument maps a source column to the name of the new column.

    ``cume``: rows up to and including ties / all rows, NULL first (E16).
    ``average``: average rank of ties / non-NULL rows, NULL for NULL (F3).
    ``descending``: 1 + rows with a larger value (E18, F4).

    The ranks of the distinct values are written once; each column joins its part of them.
    """
    wanted = [(c, new, _cume) for c, new in (cume or {}).items()]
    wanted += [(c, new, _average) for c, new in (average or {}).items()]
    wanted += [(c, new, _descending) for c, new in (descending or {}).items()]
    columns = list(dict.fromkeys(c for c, _, _ in wanted))
    ranks = materialise(value_ranks(df, columns), "value_ranks", by="metric")
    out = df
    for c in columns:
        mine = ranks.where(F.col("metric") == c).select(
            F.col("value").alias("_value"),
            *[form().alias(new) for source, new, form in wanted if source == c],
        )
        out = out.join(mine, _clean(F.col(c)).eqNullSafe(F.col("_value")), "left").drop("_value")
    return out


def _clean(c: Column) -> Column:
    """As double, with NaN as NULL and -0.0 as 0.0 so that grouping and joining agree."""
    number = c.cast("double")
    return F.when(~F.isnan(number), number + F.lit(0.0))


def _before(n: str, keys: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(w), F.lit(0))


def _cume() -> Column:
    return (F.col("n_before") + F.col("n_equal")) / F.col("n_rows")


def _average() -> Column:
    place = F.col("n_before") - F.col("n_null") + (F.col("n_equal") + 1) / F.lit(2.0)
    return F.when(F.col("value").isNotNull(), place / (F.col("n_rows") - F.col("n_null")))


def _descending() -> Column:
    return F.col("n_rows") - F.col("n_before") - F.col("n_equal") + 1
