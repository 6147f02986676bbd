"""Counts taken while a job runs (A15), without extra passes over the data."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, functions as F

from .. import constants as K


class RunMetrics:
    """Named observation points along a plan, readable after the write has run."""

    def __init__(self) -> None:
        self._points: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str, **measures: Column) -> DataFrame:
        """Count rows (and further aggregates) that pass this point."""
        point = Observation()
        self._points[stage] = point
        return df.observe(point, F.count(F.lit(1)).alias("rows"),
                          *[c.alias(name) for name, c in measures.items()])

    def report(self) -> dict[str, dict]:
        """Measures by stage; blocks until the watched job has finished.

        When a job turns out to produce nothing, Spark may cut parts of its plan away at
        run time; observation points in those parts are absent from the report.
        """
        found = {}
        for stage, point in self._points.items():
            try:
                found[stage] = dict(point.get)
            except Py4JJavaError:  # the point was cut away: it holds no row to convert
                continue
        return found

    def dropped(self, before: str, after: str) -> int:
        """Rows lost between two stages."""
        found = self.report()
        return found[before]["rows"] - found[after]["rows"]


def null_counts(columns: list[str]) -> dict[str, Column]:
    """Number of NULLs per column, as aggregates."""
    return {f"null_{c}": F.count_if(F.col(c).isNull()) for c in columns}


def harvest_alerts(metrics: DataFrame) -> DataFrame:
    """One row per alert from a metrics row with ``coverage`` and ``failed``."""
    alerts = F.array(
        F.when(F.col("coverage") < K.COVERAGE_ALERT_PCT, F.lit("coverage below 95 %")),
        F.when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" file downloads failed"))),
    )
    return metrics.select(F.explode(F.filter(alerts, lambda a: a.isNotNull())).alias("alert"))
