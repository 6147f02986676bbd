"""Column expressions over numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_double(c: Column) -> Column:
    """Number or NULL; NaN counts as missing so that it cannot poison sums.

    Text must look like a number as a whole: a cast alone would also read ``12d`` and ``7f``.
    """
    text = c.cast("string")
    infinite = text.rlike(r"(?i)^\s*[+-]?inf(inity)?\s*$")
    return F.when(text.rlike(_NUMBER) | infinite, F.nanvl(c.try_cast("double"), F.lit(None).cast("double")))


def ratio_or_null(n: Column, d: Column) -> Column:
    """n / d, NULL when the denominator is zero or missing."""
    return F.when(d != 0, n / d)


def ratio_or_zero(n: Column, d: Column) -> Column:
    """n / d, 0 when the denominator is not positive or the ratio is missing."""
    return F.coalesce(F.when(d > 0, n / d), F.lit(0.0))


def capped(c: Column, top: float = 1.0) -> Column:
    """Clip from above, keeping NULL (``least`` alone would skip it)."""
    return F.when(c > top, F.lit(top)).otherwise(c)
