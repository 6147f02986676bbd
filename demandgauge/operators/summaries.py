"""Subtotals over any set of dimensions, and sketches per point and month that merge over any months.

Both rest on a table that is reduced once: sums per combination of the finest dimensions, or sketches per point and
month.  Subtotals expand only those sums; questions over months merge only sketches, never sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import month_key

#: Log2 of the registers of a distinct count (relative standard error 1.04 / sqrt(registers)), and the size of a quantile sketch.
LG_K, QUANTILE_K = 12, 400
#: Bounds that hold for a merged sketch, however many sketches it was merged from: three standard errors and, at
#: this size, the rank error at 99 % confidence, rounded up.
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.01


def usage_subtotals(sessions: DataFrame, sets: list[list[str]]) -> DataFrame:
    """One row per combination of the dimensions of each set, the other dimensions NULL.

    Columns: all dimensions in the order in which they first occur in ``sets``; ``level``, the bits of the dimensions summed over
    (the first dimension is the highest bit), which tells a subtotal from a NULL in the data; sessions,
    energy_kwh, occupied_minutes, mean_minutes (over sessions with a duration).  An empty set is the grand total; a set
    given twice gives its rows twice, as in SQL.  An empty table gives no rows, not even a grand total.
    """
    dims = list(dict.fromkeys(d for s in sets for d in s))
    finest = sessions.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n"), F.sum("consumption_kwh").alias("kwh"), F.sum("duration_minutes").alias("minutes"),
        F.count("duration_minutes").alias("timed"))
    return finest.groupingSets([[F.col(d) for d in s] for s in sets], *dims).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("sessions"), F.sum("kwh").alias("energy_kwh"),
        F.sum("minutes").alias("occupied_minutes"), (F.sum("minutes") / F.nullif(F.sum("timed"), F.lit(0))).alias("mean_minutes"))


def rollup_sets(dims: list[str]) -> list[list[str]]:
    """All dimensions, then ever fewer from the right, then the grand total."""
    return [dims[:i] for i in range(len(dims), -1, -1)]


def cube_sets(dims: list[str]) -> list[list[str]]:
    """Every subset of the dimensions."""
    return [[d for i, d in enumerate(dims) if m >> i & 1] for m in reversed(range(1 << len(dims)))]


def monthly_sketches(sessions: DataFrame, keys: list[str], user: Column, month: Column | None = None) -> DataFrame:
    """(keys, year_month, sessions, users, minutes): binary sketches of distinct users and of durations.

    To be stored and appended to; several rows of one key and month are as good as one.  NULL users and durations
    leave no trace; a key without any has an empty sketch (users) or NULL (minutes).
    """
    month = month_key(F.col("start_time")) if month is None else month
    return sessions.groupBy(*keys, month.alias("year_month")).agg(
        F.count(F.lit(1)).alias("sessions"), F.hll_sketch_agg(user, F.lit(LG_K)).alias("users"),
        F.kll_sketch_agg_double(F.when(~F.isnan("duration_minutes"), F.col("duration_minutes")), F.lit(QUANTILE_K)).alias("minutes"))


def merged_use(sketches: DataFrame, by: list[str], quantiles: list[float]) -> DataFrame:
    """(by, sessions, users, q<percent> ...): sketches merged over whatever rows are given.

    ``users`` is off by at most ``DISTINCT_ERROR`` of itself, a quantile by ``RANK_ERROR`` of the rows, at the stated confidence.
    """
    merged = sketches.groupBy(*by).agg(
        F.sum("sessions").alias("sessions"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"),
        F.kll_merge_agg_double("minutes", F.lit(QUANTILE_K)).alias("minutes"))
    some = F.coalesce(F.kll_sketch_get_n_double("minutes"), F.lit(0)) > 0
    return merged.select(*by, "sessions", "users", *[
        F.when(some, F.kll_sketch_get_quantile_double("minutes", F.lit(q))).alias(f"q{round(100 * q)}") for q in quantiles])
