"""Range frames, previous rows and row numbers whose windows stay bounded, however many rows a key has.

Time is cut into slices and windows are partitioned by (key, slice).  A range frame reaches back by a fixed time, so each
slice also gets the rows of that time before it, as context only.  A previous row can lie any time back, so the last
row of each slice is carried on over the slices of its key, as in the sweep.  Row numbers over a whole table come from
ordered partitions and the counts of those before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .asof import micros, slice_of

SLICE_SECONDS = 28 * 86400


def rolling(df: DataFrame, keys: list[str], time: str, back_seconds: int, measures: dict[str, Column], slice_seconds: int | None = None) -> DataFrame:
    """Add each measure (an aggregate) over the rows of the key from ``back_seconds`` before the row's time up to it.

    Both ends count, also rows at the same time.  Rows with a NULL key form a key; rows with a NULL time get the
    measure over the NULL times of their key, as in SQL.  Slices must be at least as long as the frame.
    """
    slice_seconds = slice_seconds or max(SLICE_SECONDS, back_seconds)
    if slice_seconds < back_seconds:
        raise ValueError("a slice must be at least as long as the frame")
    width, back = slice_seconds * 1_000_000, back_seconds * 1_000_000
    placed = df.withColumn("_us", micros(time)).withColumn("_at", slice_of(F.col("_us"), width))
    near_end = F.col("_us") + back >= (F.col("_at") + 1) * width
    copies = F.array_compact(F.array(F.struct(F.col("_at").alias("_slice"), F.lit(True).alias("_own")), F.when(
        near_end, F.struct((F.col("_at") + 1).alias("_slice"), F.lit(False).alias("_own")))))
    rows = placed.select("*", F.inline(copies)).drop("_at")
    frame = Window.partitionBy(*keys, "_slice").orderBy("_us").rangeBetween(-back, Window.currentRow)
    return rows.withColumns({name: c.over(frame) for name, c in measures.items()}).where("_own").select(*df.columns, *measures)


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add columns of the row before in the key's order: ``columns`` maps a column to the name of the new one.

    ``order``: the time and what breaks ties; it should name a row within its key.  The first row of a key gets NULLs; so do
    rows with a NULL key or time, which nobody has as previous either.
    """
    width, cut = slice_seconds * 1_000_000, [*keys, "_slice"]
    placed = df.withColumn("_us", micros(order[0])).withColumn("_slice", slice_of(F.col("_us"), width))
    lacking = F.col("_us").isNull()
    for k in keys:
        lacking = lacking | F.col(k).isNull()
    rows = placed.where(~lacking)
    value = F.struct(*[F.col(c).alias(new) for c, new in columns.items()])
    lasts = rows.groupBy(*cut).agg(F.max_by(value, F.struct("_us", *order[1:])).alias("_last"))
    carried = lasts.select(*cut, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_before")).where("_before IS NOT NULL")
    merged = rows.withColumn("_value", value).unionByName(
        carried.select(*cut, F.col("_before").alias("_value"), (F.col("_slice") * width - 1).alias("_us")), allowMissingColumns=True)
    in_slice = Window.partitionBy(*cut).orderBy("_us", *order[1:])
    opening = F.col("_us") < F.col("_slice") * width
    # The opening row has the value of the last row before its slice and sorts first in it.
    found = merged.withColumn("_before", F.lag("_value").over(in_slice)).where(~opening)
    return found.select(*df.columns, *[F.col("_before")[new].alias(new) for new in columns.values()]).unionByName(
        placed.where(lacking).select(*df.columns), allowMissingColumns=True)


def with_row_number(df: DataFrame, order: list[str], name: str = "row_number", total: str | None = None) -> DataFrame:
    """Add the place of each row in the ascending order of the whole table, from 1, and the number of rows as ``total``.

    The table is range-partitioned, sorted and written once; one count per partition gives where each begins.
    NULLs come first; rows that are equal in ``order`` are numbered in any order.
    """
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            place = pa.array(range(at + 1, at + batch.num_rows + 1), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, place], [*batch.schema.names, "_place"])
            at += batch.num_rows

    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"))
    inner = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    placed = materialise(ordered.mapInArrow(number, f"{inner}, _part int, _place bigint"), "numbered")
    # As many rows as the sort had partitions.
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    numbered = placed.join(F.broadcast(starts), "_part")
    return numbered.select(*df.columns, (F.col("_start") + F.col("_place")).alias(name), *([F.col("_total").alias(total)] if total else []))


def ntile(row_number: str, total: str, n: int) -> Column:
    """SQL's NTILE(n) from a row number and the number of rows: the first total % n tiles have a row more."""
    place, each, more = F.col(row_number) - 1, F.call_function("div", F.col(total), F.lit(n)), F.col(total) % n
    wide = more * (each + 1)
    return F.when(place < wide, F.call_function("div", place, each + 1)).otherwise(
        more + F.call_function("div", place - wide, F.greatest(each, F.lit(1)))).cast("int") + 1
