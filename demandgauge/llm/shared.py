"""What several operators need: row keys, column names without clashes, and written intermediate tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgauge.session import working_folder


def write_once(df: DataFrame, label: str, compression: str = "snappy", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: no recomputation, lineage cut, sizes known to Spark."""
    path = os.path.join(working_folder(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs inside hands Python workers at most ``most`` rows at a time; a plan that runs later is not affected."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_column: str, text_column: str) -> list[Column]:
    """128 bits that name a row by its id and whole text; rows equal in both have equal results."""
    ident, text = F.col(id_column).cast("string"), F.col(text_column)
    return [F.xxhash64(ident, text).alias("_k1"), F.xxhash64(text, F.lit("\u0001"), ident, F.length(text)).alias("_k2")]


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())
