"""The ledger of landing files: what became of each file in each run.

A run notes its files as ``started`` before it writes sessions and their outcome afterwards: ``stored`` with
sessions in the table, ``empty`` without any, ``unusable`` with the reason.  So finding new files reads this
small table instead of the sessions.  A run that died between the two notes leaves files open; only for
these the session table itself is asked, so nothing is stored twice and nothing is left out.

Defined results: the latest run decides about a file that several runs met; a table written before there was a ledger
is read once and noted; a file name that lands in two folders is one file, as its sessions cannot be told apart.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import scan_if_exists

STARTED, STORED, EMPTY, UNUSABLE = "started", "stored", "empty", "unusable"
SCHEMA = "file_name string, state string, reason string, run string, run_at timestamp"


@dataclass(frozen=True)
class Run:
    """Name and start of one run; all its notes carry both."""

    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    started_us: int = field(default_factory=lambda: time.time_ns() // 1000)


def ledger_path(table: str) -> str:
    return table.rstrip("/") + "_files"


def note(files: DataFrame, table: str, run: Run, state: str | None = None, mode: str = "append") -> None:
    """Write one note per row of ``files`` (file_name, and state and reason unless ``state`` is given)."""
    if state is not None:
        files = files.select("file_name", F.lit(state).alias("state"), F.lit(None).cast("string").alias("reason"))
    files.select("file_name", "state", "reason", F.lit(run.name).alias("run"),
                 F.timestamp_micros(F.lit(run.started_us)).alias("run_at")).hint("rebalance").write.mode(mode).parquet(ledger_path(table))


def latest(notes: DataFrame) -> DataFrame:
    """(file_name, state, reason, run, run_at) of the last note of every file; within a run the outcome is the last."""
    order = F.struct("run_at", "run", F.col("state") != STARTED)
    picked = notes.groupBy("file_name").agg(F.max_by(F.struct("state", "reason", "run", "run_at"), order).alias("last"))
    return picked.select("file_name", "last.*")


def outcomes(names: DataFrame, stored: list[str], unusable: DataFrame) -> DataFrame:
    """State and reason of a run's files: ``names`` (file_name), those with ``stored`` sessions, ``unusable`` (file, reason)."""
    spark = names.sparkSession
    held = spark.createDataFrame([(n,) for n in stored], "file_name string").withColumn("held", F.lit(True))
    bad = unusable.groupBy(F.col("file").alias("file_name")).agg(F.min("reason").alias("reason"))
    state = F.when(F.col("held"), STORED).when(F.col("reason").isNotNull(), UNUSABLE).otherwise(EMPTY)
    return names.distinct().join(held, "file_name", "left").join(bad, "file_name", "left").select(
        "file_name", state.alias("state"), F.when(state == UNUSABLE, F.col("reason")).alias("reason"))


def stored_files(spark: SparkSession, table: str) -> DataFrame | None:
    """(file_name) of the files with sessions in ``table``; None when there is no table yet."""
    sessions = scan_if_exists(spark, table)
    if sessions is None:
        return None
    held = sessions.select(F.col("source_file").alias("file_name"))
    notes = scan_if_exists(spark, ledger_path(table))
    if notes is None:
        note(held.distinct(), table, Run(), STORED)
        notes = spark.read.schema(SCHEMA).parquet(ledger_path(table))
    state = latest(notes)
    done, left_open = (state.where(F.col("state") == s).select("file_name") for s in (STORED, STARTED))
    if left_open.isEmpty():
        return done
    return done.unionByName(held.join(left_open, "file_name", "left_semi").distinct())
