"""Spark session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_local_folder: list[str] = []


def local_session(cores: str = "*", partitions: int = 8, app: str = "demandgauge") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per session, where they do not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_demandgauge_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="demandgauge-package-"), "demandgauge.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("demandgauge", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._demandgauge_shipped = True


def working_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, shared by all executors.

    Only a local-mode session without that setting gets a temporary folder; on a
    cluster a machine-local folder would not be readable by other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not (spark.conf.get("spark.master", "") or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="demandgauge-"))
    return _local_folder[0]


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Used where several branches read the same expensive result: the files survive
    the loss of executors, allow column pruning per branch, and carry sizes from
    which Spark decides about broadcasting.  ``by`` names a column with few values on which
    the branches filter.
    """
    path = os.path.join(working_folder(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
