"""Nested locations to one row per connector, with curated corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K, schemas
from ..functions.numbers import to_double
from ..functions.text import lookup, power_type
from ..session import materialise
from .cleaning import conform, dedup_first, enforce_not_null


def with_coords(locs: DataFrame) -> DataFrame:
    """Numeric coordinates; NULL when absent or not a number."""
    return locs.withColumns({
        "latitude": to_double(F.col("coordinates.latitude")),
        "longitude": to_double(F.col("coordinates.longitude")),
    })


def _has_coords() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def flatten_connectors(locs: DataFrame) -> DataFrame:
    """One row per connector in feed order; parts without an id or detail are left out.

    ``locs``: loc_no and the location fields.  ``feed_order`` is the document position.
    """
    evses = with_coords(locs).where(_has_coords()).select(
        "loc_no", "name", "address", "city", "postal_code", "latitude", "longitude",
        F.posexplode("evses").alias("evse_no", "evse"),
    )
    rows = evses.where(F.col("evse.id").isNotNull()).select(
        "*", F.posexplode("evse.connectors").alias("conn_no", "connector"))
    return rows.where(F.col("connector.id").isNotNull()).select(
        F.col("evse.id").alias("cp_id"),
        F.col("connector.id").alias("connector_id"),
        F.col("name").alias("site_name"), "address", "city", F.col("postal_code").alias("postcode"),
        "latitude", "longitude",
        power_type(F.col("connector.power_type")).alias("connector_type"),
        to_double(F.col("connector.max_charge_rate")).alias("max_charge_rate_kw"),
        F.col("evse.status").alias("network_status"),
        F.struct("loc_no", "evse_no", "conn_no").alias("feed_order"),
    )


def skip_counts(locs: DataFrame) -> DataFrame:
    """D3: locations without coordinates, EVSEs without id or connectors, connectors without id."""
    placed = with_coords(locs)
    usable = F.filter(F.coalesce("evses", F.array().cast(schemas.LOCATION["evses"].dataType)),
                      lambda e: e["id"].isNotNull() & (F.coalesce(F.size(e["connectors"]), F.lit(0)) > 0))
    no_id = F.size(F.filter(F.flatten(F.transform(usable, lambda e: e["connectors"])),
                            lambda c: c["id"].isNull()))
    all_evses = F.coalesce(F.size("evses"), F.lit(0))
    return placed.agg(
        F.count_if(~_has_coords()).alias("locations"),
        F.sum(F.when(_has_coords() & F.col("evses").isNotNull(), all_evses - F.size(usable)).otherwise(0)).alias("evses"),
        F.sum(F.when(_has_coords(), no_id).otherwise(0)).alias("connectors"),
    ).withColumn("skipped", F.col("locations") + F.col("evses") + F.col("connectors"))


def dedup_connectors(rows: DataFrame) -> DataFrame:
    """The first row of each (charge point, connector) in feed order."""
    return dedup_first(rows, ["cp_id", "connector_id"], "feed_order")


def with_n_connectors(rows: DataFrame) -> DataFrame:
    """Number of connectors of the charge point, on every row of deduplicated connectors.

    Counted by an aggregate and joined back, so a charge point with very many rows is
    combined before the shuffle.
    """
    counts = rows.groupBy("cp_id").agg(F.count(F.lit(1)).cast("int").alias("n_connectors"))
    return rows.join(counts, "cp_id")


def apply_overrides(
    rows: DataFrame,
    postcodes: dict[str, str] | DataFrame | None = None,
    coordinates: dict[str, tuple[float, float]] | DataFrame | None = None,
) -> DataFrame:
    """Curated postcode and coordinates win over the feed; ``*_source`` tells which was used.

    Small corrections come as a dictionary (the built-in ones by default), large ones as a
    DataFrame keyed by cp_id (columns ``postcode``; ``latitude``, ``longitude``).
    """
    postcodes = K.POSTCODE_OVERRIDES if postcodes is None else postcodes
    coordinates = K.COORDINATE_OVERRIDES if coordinates is None else coordinates
    key = F.col("cp_id")
    if isinstance(postcodes, dict):
        rows = rows.withColumn("_postcode", lookup(key, postcodes) if postcodes else F.lit(None).cast("string"))
    else:
        fixes = postcodes.select("cp_id", F.col("postcode").alias("_postcode"))
        rows = rows.join(fixes, "cp_id", "left")
    if isinstance(coordinates, dict):
        def half(i: int) -> Column:
            if not coordinates:
                return F.lit(None).cast("double")
            return lookup(key, {k: v[i] for k, v in coordinates.items()})
        rows = rows.withColumns({"_latitude": half(0), "_longitude": half(1)})
    else:
        fixes = coordinates.select(
            "cp_id", F.col("latitude").alias("_latitude"), F.col("longitude").alias("_longitude"))
        rows = rows.join(fixes, "cp_id", "left")
    return rows.withColumns({
        "postcode": F.coalesce("_postcode", "postcode"),
        "postcode_source": F.when(F.col("_postcode").isNotNull(), "override").otherwise("feed"),
        "latitude": F.coalesce("_latitude", "latitude"),
        "longitude": F.coalesce("_longitude", "longitude"),
        "coord_source": F.when(F.col("_latitude").isNotNull(), "override").otherwise("feed"),
    }).drop("_postcode", "_latitude", "_longitude")


def with_feed_lineage(rows: DataFrame, snapshot_name: str, now: Column | None = None) -> DataFrame:
    """Name of the snapshot file and time of the run."""
    return rows.withColumns({
        "source_snapshot": F.lit(snapshot_name),
        "ingested_at": F.current_timestamp() if now is None else now,
    })


def charge_points(locs: DataFrame, snapshot_name: str, now: Column | None = None,
                  postcodes=None, coordinates=None) -> DataFrame:
    """The connector table of a snapshot.

    Counting connectors reads the deduplicated rows twice, so they are written once.
    """
    rows = with_n_connectors(materialise(dedup_connectors(flatten_connectors(locs)), "connectors"))
    stamped = apply_overrides(with_feed_lineage(rows, snapshot_name, now), postcodes, coordinates)
    return conform(enforce_not_null(stamped, schemas.CHARGE_POINTS), schemas.CHARGE_POINTS)
