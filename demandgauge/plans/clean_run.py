"""Landing files to the clean session table, incremental or from scratch."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import basename
from ..operators.cleaning import clean_sessions, typed_sessions, without_known
from ..operators.metrics import RunMetrics
from ..session import materialise
from ..sources import landing, ledger, tables, xlsx


@dataclass
class CleanReport:
    """What a run did: measures per stage, and the files it could not use with the reason."""

    files: int
    quarantined: DataFrame | None = None
    measures: dict[str, dict] = field(default_factory=dict)

    @property
    def rows_written(self) -> int:
        return self.measures.get("written", {}).get("rows", 0)


def read_files(spark: SparkSession, paths: list[str], multi_line: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """Raw rows of all usable files, and (file, reason) of the others."""
    csv = [p for p in paths if p.lower().endswith(".csv")]
    books = [p for p in paths if p.lower().endswith(".xlsx")]
    rows, plans = [], []
    if csv:
        plan = materialise(landing.plan_headers(landing.csv_headers(spark, csv)), "csv_plan")
        rows.append(landing.read_session_csv(spark, plan, multi_line))
        plans.append(plan.select("path", "reason"))
    if books:
        # Parsed once: both the layouts and the rows are read from the written table.
        parsed = materialise(xlsx.read_workbooks(spark, books), "workbooks")
        plan = xlsx.workbook_plan(parsed)
        rows.append(xlsx.session_rows(parsed, plan))
        plans.append(plan.select("path", "reason"))
    rows = [r for r in rows if r is not None]
    raw = rows[0].unionByName(rows[1]) if len(rows) == 2 else (rows[0] if rows else None)
    status = plans[0].unionByName(plans[1]) if len(plans) == 2 else plans[0]
    bad = status.where("reason IS NOT NULL").select(basename(F.col("path")).alias("file"), "reason")
    return raw, bad


def run_clean(spark: SparkSession, landing_path: str | list[str], table: str, full_refresh: bool = False,
              against_stored: bool = False, valid_first: bool = False, multi_line: bool = False) -> CleanReport:
    """Clean the landing files that are not in the table yet, or all of them.

    ``against_stored`` also drops sessions that earlier runs have stored.  ``multi_line`` reads quoted
    line breaks in CSV cells, at the price of one task per file.
    """
    stored = None if full_refresh else ledger.stored_files(spark, table)
    files = landing.not_stored(landing.list_landing(spark, landing_path), stored)
    listed = list(files.select("path", "length").orderBy("path").toLocalIterator())
    paths = [r.path for r in listed if r.length > 0]
    empty = files.where("length = 0").select(
        F.col("file_name").alias("file"), F.lit("file is empty").alias("reason"))
    report = CleanReport(files=len(listed), quarantined=empty)
    if not paths:
        if listed:
            names = empty.select(F.col("file").alias("file_name"))
            ledger.note(ledger.outcomes(names, [], empty), table, ledger.Run())
        return report
    names = materialise(files.select("file_name"), "run_files")
    raw, unusable = read_files(spark, paths, multi_line)
    report.quarantined = materialise(empty.unionByName(unusable), "set_aside")
    run = ledger.Run()
    if raw is None:
        ledger.note(ledger.outcomes(names, [], report.quarantined), table, run)
        return report
    metrics = RunMetrics()
    clean = clean_sessions(typed_sessions(raw), metrics=metrics, valid_first=valid_first)
    known = tables.scan_if_exists(spark, table) if against_stored and not full_refresh else None
    if known is not None:
        clean = without_known(clean, known)
    report.measures = store_noted(clean, table, names, report.quarantined, run, metrics, full_refresh)
    return report


def store_noted(clean: DataFrame, table: str, names: DataFrame, unusable: DataFrame, run: ledger.Run,
                metrics: RunMetrics, full_refresh: bool = False) -> dict[str, dict]:
    """Write cleaned sessions between the two notes of the ledger; the measures of the run.

    ``names`` (file_name) are all files of the run, ``unusable`` (file, reason) those set aside.
    A full refresh replaces the ledger too, unless it finds no sessions and so leaves the table alone.
    """
    clean = metrics.watch(clean, "stored", files=F.collect_set("source_file"))
    mode = "append"
    if full_refresh:
        # An empty result must not wipe the table, so it is written aside first.
        clean = materialise(clean, "clean_sessions")
        if clean.isEmpty():
            return metrics.report()
        mode = "overwrite"
    ledger.note(names.distinct(), table, run, ledger.STARTED)
    tables.write_sessions(clean, table, mode)
    measures = metrics.report()
    stored = measures.get("stored", {}).get("files") or []
    ledger.note(ledger.outcomes(names, list(stored), unusable), table, run, mode=mode)
    return measures
