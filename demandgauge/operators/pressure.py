"""Demand-pressure index per charge point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K, schemas
from ..functions.numbers import capped, ratio_or_null
from ..functions.text import postcode_area
from ..functions.times import end_or_planned, hours_between, hours_between_seconds
from ..session import materialise
from .metrics import RunMetrics
from .ranking import with_percentiles
from .sweep import saturated_hours

_REFERENCE_COLUMNS = ["n_connectors", "site_name", "postcode", "latitude", "longitude"]


def cp_reference(connectors: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per charge point, the first non-NULL value of each attribute.

    "First" is by connector_id, which makes the choice repeatable.
    """
    first = [
        F.min_by(F.when(F.col(c).isNotNull(), F.col(c)),
                 F.when(F.col(c).isNotNull(), F.col("connector_id"))).alias(c)
        for c in (columns or _REFERENCE_COLUMNS)
    ]
    return connectors.groupBy("cp_id").agg(*first)


def with_k(sessions: DataFrame, reference: DataFrame) -> DataFrame:
    """Sessions with the capacity of their charge point; unknown points drop.

    No broadcast hint: Spark broadcasts the reference when its size allows and
    shuffles (with skew handling) beyond that.
    """
    return sessions.join(reference.select("cp_id", "n_connectors"), "cp_id", "inner")


def with_end_filled(sessions: DataFrame) -> DataFrame:
    """End time or planned end, and occupied hours."""
    return sessions.withColumns({
        "end_time_filled": end_or_planned(
            F.col("start_time"), F.col("end_time"), F.col("duration_minutes")),
        "occupied_hours": F.col("duration_minutes") / 60.0,
    })


def connector_windows(sessions: DataFrame) -> DataFrame:
    """E5, with the sums of E7 per connector so that one pass over the sessions is enough.

    Input from :func:`with_end_filled`.
    """
    return (
        sessions.groupBy("cp_id", "connector")
        .agg(
            F.min("start_time").alias("first_seen"),
            F.max("end_time_filled").alias("last_seen"),
            F.count(F.lit(1)).alias("sessions"),
            F.sum("occupied_hours").alias("occupied_hours"),
            F.sum("consumption_kwh").alias("energy_kwh"),
            F.sum("amount").alias("revenue"),
        )
        .withColumn("available_hours", hours_between_seconds(F.col("first_seen"), F.col("last_seen")))
    )


def cp_usage(windows: DataFrame) -> DataFrame:
    """Availability and totals per charge point from its connector windows."""
    return windows.groupBy("cp_id").agg(
        F.sum("available_hours").alias("available_connector_hours"),
        F.sum("sessions").alias("total_sessions"),
        F.sum("occupied_hours").alias("occupied_hours"),
        F.sum("energy_kwh").alias("total_energy_kwh"),
        F.sum("revenue").alias("total_revenue"),
        hours_between(F.min("first_seen"), F.max("last_seen")).alias("cp_available_hours"),
    )


def cp_metrics(sessions: DataFrame, connectors: DataFrame) -> DataFrame:
    """All measures of every charge point that has sessions and a location.

    Sessions are reduced per charge point before anything is joined to them.
    """
    filled = with_end_filled(sessions)
    reference = cp_reference(connectors)
    busy = saturated_hours(
        filled.select("cp_id", "start_time", F.col("end_time_filled").alias("end_time")),
        reference,
    )
    return (
        cp_usage(connector_windows(filled))
        .join(busy, "cp_id")
        .join(reference, "cp_id")
        .withColumns({
            "utilisation": utilisation(),
            "saturation_rate": saturation_rate(),
            "revenue_per_connector": ratio_or_null(F.col("total_revenue"), F.col("n_connectors")),
            "single_connector": F.col("n_connectors") == 1,
        })
    )


def utilisation() -> Column:
    """Occupied share of available connector hours, at most 1, NULL without availability."""
    return capped(ratio_or_null(F.col("occupied_hours"), F.col("available_connector_hours")))


def saturation_rate() -> Column:
    """Saturated share of available hours, NULL without availability."""
    return ratio_or_null(F.col("saturated_hours"), F.col("cp_available_hours"))


def rankable(points: DataFrame, min_sessions: int = K.MIN_SESSIONS) -> DataFrame:
    """Enough sessions and known coordinates."""
    return points.where(
        (F.col("total_sessions") >= min_sessions)
        & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )


def weighted_score(parts: dict[str, float]) -> Column:
    """Weighted mean of percentile columns (column name -> weight)."""
    (first, w), *rest = parts.items()
    total = F.lit(w) * F.col(first)
    for name, weight in rest:
        total = total + F.lit(weight) * F.col(name)
    return total / F.lit(sum(parts.values()))


def rank_points(
    points: DataFrame,
    weights: dict[str, float] | None = None,
    ranks: Callable[..., DataFrame] = with_percentiles,
) -> DataFrame:
    """Percentile of each rate, weighted score, and rank by score.

    ``ranks`` is one of the two forms in :mod:`ranking`.
    """
    weights = weights or K.PRESSURE_WEIGHTS
    scored = ranks(points, cume={c: f"{c}_pct" for c in weights}).withColumn(
        "pressure_score", weighted_score({f"{c}_pct": w for c, w in weights.items()})
    )
    return ranks(scored, descending={"pressure_score": "pressure_rank"})


def pressure_index(
    sessions: DataFrame,
    connectors: DataFrame,
    min_sessions: int = K.MIN_SESSIONS,
    weights: dict[str, float] | None = None,
    metrics: RunMetrics | None = None,
) -> DataFrame:
    """E1-E20 without the time stamp: the ranked index, one row per charge point.

    Ranking reads the measures several times, so they are written once to the shared
    folder; the sessions are scanned by that write only.  The row count comes from the
    footers of the written files.  ``metrics`` receives the points before and after the floor.
    """
    metrics = metrics or RunMetrics()
    points = metrics.watch(cp_metrics(sessions, connectors), "measured")
    kept = metrics.watch(rankable(points, min_sessions), "rankable")
    measured = materialise(kept, "cp_metrics")
    ranked = rank_points(measured, weights)
    return ranked.withColumn("postcode_area", postcode_area(F.col("postcode")))


def gold(index: DataFrame, now: Column | None = None) -> DataFrame:
    """The index in its published columns, types and order."""
    stamped = index.withColumn("ingested_at", F.current_timestamp() if now is None else now)
    return stamped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.PRESSURE])
