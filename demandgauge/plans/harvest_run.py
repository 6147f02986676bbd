"""Pages to the file catalog, its completeness report and the files still to fetch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import catalog as C
from ..operators.metrics import harvest_alerts
from ..session import materialise


@dataclass
class Harvest:
    """All results of one look at the pages."""

    catalog: DataFrame
    missing: DataFrame
    completeness: DataFrame
    pending: DataFrame
    alerts: DataFrame


def run_harvest(pages: DataFrame, calendar: DataFrame, files: DataFrame, failed: int = 0) -> Harvest:
    """B1-B16; the pages are parsed once."""
    catalog = materialise(C.session_catalog(pages), "catalog")
    report = C.completeness(catalog, calendar)
    return Harvest(
        catalog=catalog,
        missing=C.missing_months(catalog, calendar),
        completeness=report,
        pending=C.pending_downloads(catalog, files),
        alerts=harvest_alerts(report.withColumn("failed", F.lit(failed))),
    )
