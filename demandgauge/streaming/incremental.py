"""The landing zone as a stream (S1): the checkpoint remembers which files are done."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import basename
from ..operators.cleaning import clean_sessions, typed_sessions
from ..operators.metrics import RunMetrics
from ..plans.clean_run import read_files, store_noted
from ..session import materialise
from ..sources import ledger
from ..sources.landing import not_stored


def clean_stream(spark: SparkSession, landing_path: str, table: str, checkpoint: str,
                 files_per_batch: int | None = None, quarantine: str | None = None, multi_line: bool = False) -> StreamingQuery:
    """Clean all files that arrived since the last call, then stop.

    Only paths travel through the stream; each batch is cleaned by the same operators as a
    batch run and appended to the same table in the same layout, so both kinds of run can
    take turns.  They share the ledger of files too: a batch repeated after a failure leaves out the files whose
    sessions it has already stored, without reading the session table.  Files without valid rows are remembered too and not read again; unusable
    files go with their reason to ``quarantine`` (default: the table's path with ``_quarantined``),
    one folder per batch, replaced when the batch is repeated.
    """
    quarantine = quarantine or table.rstrip("/") + "_quarantined"
    reader = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arrivals = reader.load(landing_path).select("path").where("lower(path) rlike '[.](xlsx|csv)$'")

    def clean_batch(batch: DataFrame, number: int) -> None:
        named = batch.withColumn("file_name", basename(F.col("path")))
        spark, run = batch.sparkSession, ledger.Run()
        fresh = materialise(not_stored(named, ledger.stored_files(spark, table)), "run_files")
        paths = sorted(r.path for r in fresh.select("path").toLocalIterator())
        if paths:
            raw, unusable = read_files(spark, paths, multi_line)
            unusable = materialise(unusable, "set_aside")
            names = fresh.select("file_name")
            if raw is None:
                ledger.note(ledger.outcomes(names, [], unusable), table, run)
            else:
                metrics = RunMetrics()
                store_noted(clean_sessions(typed_sessions(raw), metrics=metrics), table, names, unusable, run, metrics)
            unusable.write.mode("overwrite").parquet(os.path.join(quarantine, f"batch={number}"))

    return (
        arrivals.writeStream.foreachBatch(clean_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
