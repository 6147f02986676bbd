"""Interval join: pairs of rows of one key whose time spans overlap.

Time is cut into buckets on several levels, each ``2 ** STEP`` times as wide as the one below.  A span is at
home on the lowest level whose buckets are as wide as it is long, so it touches one or two of them.
A pair meets on the home level of its longer span: there the longer one is looked up by its
own buckets, the shorter one by the buckets it falls into.  Rows of one home level meet each other directly.
Hence a long span is carried over to few wide buckets instead of many narrow ones, and every pair meets by
an equi-join on (key, role, level, bucket): no nested loop, no cartesian product.  A pair that shares two
buckets counts in the one where the later start lies, so nothing has to be made distinct.

One key may hold any share of the rows.  Its rows are spread over buckets of time; where many short spans meet
one long span in a bucket that is wide for them, the short ones are dealt out by hash and the long one is offered to every
share: one share where the levels are neighbours, twice as many per level further apart, ``SHARES`` at most.
Levels that the other side does not use make no cells (a broadcast of few rows per level).

Who asks only how many rows and how much time meet each row (``load``) gets that without any pair: running sums of the
starts and ends over slices of time, as in the sweep, are read off where the spans of the other side start and end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import computed_once
from .asof import slice_of

#: Width of the finest bucket, number of levels, doublings from one level to the next, most shares of a wide bucket.
FINEST_SECONDS, LEVELS, STEP, SHARES = 3600, 6, 4, 8
#: Width of a slice of the running sums.
SLICE_SECONDS = 86400
_BOTH, _LEFT_LONG, _RIGHT_LONG = 0, 1, 2
_CLOSING, _CHANGE, _OPENING = range(3)


def interval_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str],
    finest_seconds: int = FINEST_SECONDS, load: tuple[str, str] | None = None,
) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal ``keys`` whose half-open spans overlap, all columns of both.

    ``load``: instead of the pairs, every row of ``right`` that is in one, with two columns of these names, the number of its pairs
    and the sum of their overlaps in whole seconds (both ends rounded down); linear in the rows, however many pairs there are.
    A row with a NULL key, start or end, or that ends where or before it starts, overlaps nothing.  Rows that
    repeat pair like any others.  Apart from the keys, column names must differ.
    """
    common = (set(left.columns) & set(right.columns)) - set(keys)
    if common:
        raise ValueError(f"columns on both sides: {sorted(common)}")
    if load:
        return _load(left, right, keys, left_span, right_span, *load)
    finest = finest_seconds * 1_000_000
    long = _at_home(left, keys, left_span, "_l", finest), _at_home(right, keys, right_span, "_r", finest)
    near = _cells(*long, "_l", _LEFT_LONG, _RIGHT_LONG, finest)
    far = _cells(long[1], long[0], "_r", _RIGHT_LONG, _LEFT_LONG, finest)
    met = near.join(far, [*keys, "_cell"])
    (left_start, left_end), (right_start, right_end) = _span(left_span), _span(right_span)
    bucket = _bucket(F.greatest(left_start, right_start), F.shiftright("_cell", 8).bitwiseAND(7).cast("int"), finest)
    overlap = (left_start < right_end) & (right_start < left_end)
    return met.where(overlap & (F.shiftright("_cell", 11) == bucket)).select(
        *left.columns, *[c for c in right.columns if c not in keys])


def _span(span: tuple[str, str]) -> tuple[Column, Column]:
    return tuple(F.unix_micros(F.col(c).cast("timestamp")) for c in span)


def _at_home(df: DataFrame, keys: list[str], span: tuple[str, str], name: str, finest: int) -> DataFrame:
    start, end = _span(span)
    df = df.withColumns({f"{name}_start": start, f"{name}_end": end})
    length = F.col(f"{name}_end") - F.col(f"{name}_start")
    # Levels whose buckets are shorter than the span.
    level = sum(((length > finest << STEP * i).cast("int") for i in range(LEVELS - 1)), F.lit(0))
    return df.where(length > 0).na.drop(subset=keys).withColumn(f"{name}_level", level)


def _bucket(at: Column, level: Column, finest: int) -> Column:
    width = F.call_function("shiftleft", F.lit(finest).cast("bigint"), level * STEP)
    return F.call_function("div", at - F.pmod(at, width), width)


def _shares(gap: int) -> int:
    return min(SHARES, 1 << gap - 1)


def _cells(own: DataFrame, other: DataFrame, name: str, as_long: int, as_short: int, finest: int) -> DataFrame:
    """``own`` once per cell in which it can meet a row of ``other``: bucket, level, role and share, packed into one number."""
    other_level = next(c for c in other.columns if c in ("_l_level", "_r_level"))
    # By own level and by home level of the other side, where they meet; of several shares a long span takes all, a short one its own.
    places = []
    for mine in range(LEVELS):
        for its in range(LEVELS):
            gap = abs(mine - its)
            role = _BOTH if not gap else as_long if mine > its else as_short
            for share in range(_shares(gap) if mine > its else 1):
                places.append((mine, its, max(mine, its), role, 8 * gap + share, _shares(gap) if mine < its else 1))
    names = ("_mine", "_its", "_level", "_role", "_share", "_dealt")
    literal = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, place, strict=True)]) for place in places])
    used = other.select(F.col(other_level).alias("_m")).distinct().select("_m", F.inline(literal)).where("_its = _m").drop("_m", "_its")
    level, share = F.col("_level"), F.pmod(F.xxhash64(f"{name}_start", f"{name}_end"), "_dealt") + F.col("_share")
    buckets = F.sequence(_bucket(F.col(f"{name}_start"), level, finest), _bucket(F.col(f"{name}_end") - 1, level, finest))
    # Computed before the join, so that it stays an equi-join also where all spans are as long.
    own = computed_once(own, {f"{name}_level": F.col(f"{name}_level")})
    spread = own.join(F.broadcast(used), F.col(f"{name}_level") == F.col("_mine")).select(
        *own.columns, (level * 256 + F.col("_role") * 64 + share).cast("bigint").alias("_place"), F.explode(buckets).alias("_at"))
    return spread.select(*[c for c in own.columns if c not in (f"{name}_start", f"{name}_end", f"{name}_level")], (F.shiftleft("_at", 11) + F.col("_place")).alias("_cell"))


def _load(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], count: str, seconds: str,
) -> DataFrame:
    """Rows of ``right`` with the number of rows of ``left`` they overlap and the seconds of that.

    Rows met are those that start before the end, less those that end by the start; seconds met are the time
    integral of the concurrency up to the end, less that up to the start.
    """
    if {count, seconds} & set(right.columns):
        raise ValueError(f"columns on both sides: {sorted({count, seconds} & set(right.columns))}")
    width, cut = SLICE_SECONDS * 1_000_000, [*keys, "_slice"]

    def lasting(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        start, end = _span(span)
        return df.where(end > start).na.drop(subset=keys)

    def at(us: Column, side: int, starts: int, ends: int) -> Column:
        return F.struct(us.alias("_us"), F.lit(side).alias("_side"), F.lit(starts).cast("bigint").alias("_starts"), F.lit(ends).cast("bigint").alias("_ends"))

    def placed(df: DataFrame) -> DataFrame:
        # Whole seconds since the start of the slice.
        return df.withColumn("_slice", slice_of(F.col("_us"), width)).withColumn("_rel", F.call_function("div", F.col("_us") - F.col("_slice") * width, F.lit(1_000_000)))

    (left_start, left_end), (right_start, right_end) = _span(left_span), _span(right_span)
    net = F.col("_starts") - F.col("_ends")
    changes = placed(lasting(left, left_span).select(*keys, F.inline(F.array(at(left_start, _CHANGE, 1, 0), at(left_end, _CHANGE, 0, 1)))).groupBy(
        *keys, "_us", "_side").agg(F.sum("_starts").alias("_starts"), F.sum("_ends").alias("_ends"))).withColumn("_moved", net * F.col("_rel"))
    edges = placed(lasting(right, right_span).select(*right.columns, F.inline(F.array(at(right_start, _OPENING, 0, 0), at(right_end, _CLOSING, 0, 0)))))
    # What each slice is entered with: starts and ends before it, and the integral up to it (as a change at its start, with the sign of _moved).
    slices = changes.select(*cut, "_starts", "_ends", "_moved").unionByName(edges.select(*cut).distinct(), allowMissingColumns=True).groupBy(*cut).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_starts", "_ends", "_moved")])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    entered = F.sum(F.col("_moved") + net * F.col("_slice") * SLICE_SECONDS).over(before) - F.sum(net).over(before) * F.col("_slice") * SLICE_SECONDS
    openings = slices.select(*cut, F.sum("_starts").over(before).alias("_starts"), F.sum("_ends").over(before).alias("_ends"), entered.alias("_moved")).where(
        "_starts IS NOT NULL").withColumns({"_us": F.col("_slice") * width - 1, "_side": F.lit(_CHANGE), "_rel": F.lit(0).cast("bigint")})
    upto = Window.partitionBy(*cut).orderBy("_us", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = edges.unionByName(changes, allowMissingColumns=True).unionByName(openings, allowMissingColumns=True)
    summed = merged.withColumns({c: F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in ("_starts", "_ends", "_moved")}).where(F.col("_side") != _CHANGE)
    closing, integral = F.col("_side") == _CLOSING, F.col("_rel") * net - F.col("_moved")
    # Rows that repeat have the same figures: they are summed together and dealt out again.
    found = summed.groupBy(*right.columns).agg(
        F.sum(F.when(closing, F.col("_starts")).otherwise(-F.col("_ends"))).alias(count),
        F.sum(F.when(closing, integral).otherwise(-integral)).alias(seconds), F.count_if(closing).alias("_copies")).where(F.col(count) > 0)
    return found.select(*right.columns, *[F.call_function("div", F.col(c), F.col("_copies")).alias(c) for c in (count, seconds)], F.explode(
        F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).drop("col")
