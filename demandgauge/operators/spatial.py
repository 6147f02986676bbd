"""Nearest reference point within a radius, and lookups by postcode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.geo import METRES_PER_DEGREE, haversine_m
from ..functions.text import strip
from ..session import materialise

LEVELS = 4
SHRINK = 4


def nearest_join(points: DataFrame, references: DataFrame, radius_m: float = K.NEAREST_RADIUS_M,
                 levels: int = LEVELS) -> DataFrame:
    """Add ``nearest_postcode`` and ``distance_m`` of the nearest reference within the radius.

    ``points``: any columns with latitude and longitude.  ``references``: postcode, latitude,
    longitude.  Ties go to the smaller postcode; points without coordinates or without a
    reference in reach get NULL.

    Points are reduced to distinct coordinates and searched on grids from fine to coarse.
    On a grid of cell size c, the nine cells around a point hold every reference within c;
    a point whose best hit lies within c is settled and leaves the search.  In a dense
    town the finest grid already settles it among few candidates, and the coarse grids only
    see points whose surroundings are empty.  Places next to a pole are out of scope.
    """
    open_points = materialise(
        points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .select("latitude", "longitude").distinct(), "nearest_points")
    sites = materialise(
        references.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .groupBy("latitude", "longitude").agg(F.min("postcode").alias("postcode")), "nearest_refs")
    settled = []
    for level in reversed(range(levels)):
        reach = radius_m / SHRINK ** level
        found = _best_within(open_points, sites, reach)
        if level:
            found = materialise(found, "nearest_found")
            open_points = materialise(
                open_points.join(found, ["latitude", "longitude"], "left_anti"), "nearest_open")
        settled.append(found)
    hits = reduce(DataFrame.unionByName, settled).select(
        F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"),
        F.col("postcode").alias("nearest_postcode"), "distance_m")
    here = (F.col("latitude") == F.col("_lat")) & (F.col("longitude") == F.col("_lon"))
    return points.join(hits, here, "left").drop("_lat", "_lon")


def _best_within(points: DataFrame, sites: DataFrame, reach_m: float) -> DataFrame:
    """Nearest site of each point, for points that have one within ``reach_m``."""
    cell = reach_m / METRES_PER_DEGREE * 1.001

    def width(band: Column) -> Column:
        """Longitude width of the cells of a latitude band: reaches over both neighbour bands."""
        edge = F.greatest(F.abs((band - 1) * cell), F.abs((band + 2) * cell))
        return F.lit(cell) / F.cos(F.radians(F.least(edge, F.lit(89.0))))

    def band_of(lat: Column) -> Column:
        return F.floor(lat / cell)

    keyed = points.withColumn("band", band_of(F.col("latitude"))).withColumn(
        "cell", F.floor(F.col("longitude") / width(F.col("band"))))
    around = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    # Around the 180th meridian a site is also offered at its other longitude.
    lons = F.explode(F.filter(
        F.array(F.col("longitude"), F.col("longitude") - 360, F.col("longitude") + 360),
        lambda x: F.abs(x) <= 180 + 2 * cell / F.cos(F.radians(F.least(F.abs(F.col("latitude")) + 2 * cell, F.lit(89.0))))))
    spread = (
        sites.select("postcode", F.col("latitude").alias("s_lat"), lons.alias("s_lon"), "latitude")
        .withColumn("band", band_of(F.col("latitude"))).select("*", around.alias("d_band"))
        .withColumn("band", F.col("band") + F.col("d_band"))
        .withColumn("cell", F.floor(F.col("s_lon") / width(F.col("band"))))
        .select("postcode", "s_lat", "s_lon", "band", "cell", around.alias("d_cell"))
        .withColumn("cell", F.col("cell") + F.col("d_cell"))
        .select("postcode", "s_lat", "s_lon", "band", "cell")
    )
    distance = haversine_m(F.col("latitude"), F.col("longitude"), F.col("s_lat"), F.col("s_lon"))
    return (
        keyed.join(spread, ["band", "cell"]).withColumn("distance_m", distance)
        .where(F.col("distance_m") <= reach_m)
        .groupBy("latitude", "longitude")
        .agg(F.min(F.struct("distance_m", "postcode")).alias("best"))
        .select("latitude", "longitude", "best.postcode", "best.distance_m")
    )


def centroid_join(df: DataFrame, references: DataFrame, postcode: str = "postcode") -> DataFrame:
    """Add ``centroid_latitude`` and ``centroid_longitude`` of a postcode, NULL when unknown.

    Postcodes meet without regard to case and blanks.
    """
    def key(c: Column) -> Column:
        return F.upper(F.regexp_replace(strip(c), r"\s+", ""))

    known = references.groupBy(key(F.col("postcode")).alias("_key")).agg(
        F.min(F.struct("latitude", "longitude")).alias("_at"))
    return (
        df.withColumn("_wanted", key(F.col(postcode)))
        .join(known, F.col("_wanted") == F.col("_key"), "left")
        .withColumns({"centroid_latitude": F.col("_at.latitude"), "centroid_longitude": F.col("_at.longitude")})
        .drop("_wanted", "_key", "_at")
    )
