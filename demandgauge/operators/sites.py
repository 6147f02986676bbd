"""Roll-up of charge points to sites and the queries on sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.numbers import capped, ratio_or_zero
from ..functions.text import lookup
from ..session import materialise
from .pressure import weighted_score
from .ranking import with_percentiles

_SUMMED = [
    "n_connectors", "total_sessions", "total_energy_kwh", "occupied_hours",
    "available_connector_hours", "saturated_hours", "cp_available_hours",
]


def first_known(value: str, order: str) -> Column:
    """First non-NULL value of a group by ``order``."""
    known = F.col(value).isNotNull()
    return F.min_by(F.when(known, F.col(value)), F.when(known, F.col(order)))


def site_rollup(index: DataFrame) -> DataFrame:
    """one row per exact pair of coordinates (NULL is a place of its own).

    The charge points of a site are rows of :func:`site_members`, so that a place with
    any number of points stays one small row here.
    """
    return index.groupBy("latitude", "longitude").agg(
        *[first_known(c, "cp_id").alias(c) for c in ("site_name", "postcode", "postcode_area")],
        F.count_distinct("cp_id").alias("n_charge_points"),
        *[F.sum(c).alias(c) for c in _SUMMED],
    ).withColumn("site_key", site_key())


def site_key() -> Column:
    """coordinates rounded to six decimals, as text; NULL parts read ``nan``."""
    def part(c: str) -> Column:
        return F.coalesce(F.round(c, 6).cast("string"), F.lit("nan"))
    return F.concat(part("latitude"), F.lit(","), part("longitude"))


def site_members(index: DataFrame) -> DataFrame:
    """(site_key, latitude, longitude, cp_id), the charge points of each site."""
    return index.select(site_key().alias("site_key"), "latitude", "longitude", "cp_id").distinct()


def site_rates(sites: DataFrame) -> DataFrame:
    """rates from summed hours, 0 without a denominator, utilisation at most 1."""
    return sites.withColumns({
        "utilisation": capped(ratio_or_zero(
            F.col("occupied_hours"), F.col("available_connector_hours"))),
        "saturation_rate": ratio_or_zero(F.col("saturated_hours"), F.col("cp_available_hours")),
    })


def rank_sites(sites: DataFrame, weights: dict[str, float] | None = None,
               ranks=with_percentiles) -> DataFrame:
    """score from average-rank percentiles, and rank by score.

    ``ranks`` is one of the two forms in :mod:`ranking`.
    """
    weights = weights or K.PRESSURE_WEIGHTS
    scored = ranks(sites, average={c: f"{c}_avg_pct" for c in weights}).withColumn(
        "pressure_score", weighted_score({f"{c}_avg_pct": w for c, w in weights.items()})
    )
    return ranks(scored, descending={"pressure_score": "pressure_rank"})


def site_view(index: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """F1-F5 in one: ranked sites from the charge-point index.

    The rolled-up sites are written once, because ranking reads them several times.
    """
    rolled = materialise(site_rates(site_rollup(index)), "sites")
    return rank_sites(rolled, weights)


def located(sites: DataFrame) -> DataFrame:
    """Sites with both coordinates."""
    return sites.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def region_sites(sites: DataFrame, area: str) -> DataFrame:
    """located sites of one postcode area, best rank first."""
    return located(sites).where(F.col("postcode_area") == area).orderBy("pressure_rank")


def distinct_areas(sites: DataFrame) -> DataFrame:
    """postcode areas that occur, sorted."""
    return (
        sites.where(F.col("postcode_area").isNotNull())
        .select("postcode_area").distinct().orderBy("postcode_area")
    )


def with_area_name(df: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """F8: place name of the postcode area, the code itself when unknown.

    ``areas``: area_code, area_name; the built-in list when not given.
    """
    code = F.col("postcode_area")
    if areas is None:
        return df.withColumn("area_name", lookup(code, K.POSTCODE_AREAS, code))
    names = areas.select(F.col("area_code").alias("_code"), F.col("area_name").alias("_name"))
    return (
        df.join(names, code == F.col("_code"), "left")
        .withColumn("area_name", F.coalesce("_name", "postcode_area")).drop("_code", "_name")
    )


def region_centre(sites: DataFrame) -> DataFrame:
    """mean coordinates per postcode area, over located sites."""
    return (
        located(sites).where(F.col("postcode_area").isNotNull())
        .groupBy("postcode_area")
        .agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
             F.count(F.lit(1)).alias("n_sites"))
    )


def site_cards(sites: DataFrame) -> DataFrame:
    """the headline figures of each site, energy in MWh."""
    return sites.select(
        "site_key", "site_name", "postcode", "pressure_score", "n_charge_points", "n_connectors",
        "total_sessions", (F.col("total_energy_kwh") / 1000).alias("total_energy_mwh"),
        "utilisation", "saturation_rate",
    )


def site_card(sites: DataFrame, key: str) -> DataFrame:
    """the card of one site."""
    return site_cards(sites.where(F.col("site_key") == key))


def highlight(sites: DataFrame, area: str) -> DataFrame:
    """all located sites, flagged when they lie in the chosen area."""
    return located(sites).withColumn(
        "in_region", F.coalesce(F.col("postcode_area") == area, F.lit(False)))
