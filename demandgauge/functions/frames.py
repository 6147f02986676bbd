"""Small helpers on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose expressions are evaluated exactly once per row.

    A filter on a computed column is pushed below it and evaluates the expression again, and
    a later step may repeat it for every use.  Passing the values through ``inline`` of a
    one-element array stops both, at no shuffle; worthwhile for chains of patterns.
    """
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(values)))
