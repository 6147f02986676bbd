"""Postcode verdicts and the findings register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K, schemas
from ..functions.text import lookup, postcode_area

OPEN, RESOLVED, DISMISSED = "open", "resolved", "dismissed"


def with_areas(points: DataFrame) -> DataFrame:
    """Area of the postcode on record and of the postcode found at the coordinates."""
    return points.withColumns({
        "feed_area": postcode_area(F.col("postcode")),
        "coord_area": postcode_area(F.col("coord_postcode")),
    })


def with_verdict(points: DataFrame, allowlist: DataFrame) -> DataFrame:
    """``verdict``, NULL when the point looks right.

    ``points``: feed_area, coord_area.  ``allowlist``: area_code.
    """
    codes = allowlist.select("area_code").distinct()
    feed = codes.withColumnRenamed("area_code", "_feed")
    coord = codes.withColumnRenamed("area_code", "_coord")
    return (
        points.join(feed, F.col("feed_area") == F.col("_feed"), "left")
        .join(coord, F.col("coord_area") == F.col("_coord"), "left")
        .withColumn("verdict", F.when(F.col("feed_area").isNull(), "postcode_missing")
                    .when(F.col("_feed").isNull(), "postcode_not_scottish")
                    .when(F.col("_coord").isNotNull() & (F.col("coord_area") != F.col("feed_area")),
                          "area_mismatch"))
        .drop("_feed", "_coord")
    )


def flagged(points: DataFrame) -> DataFrame:
    """Points with a verdict."""
    return points.where(F.col("verdict").isNotNull())


def verdict_counts(points: DataFrame) -> DataFrame:
    """Points per verdict (NULL: nothing found)."""
    return points.groupBy("verdict").agg(F.count(F.lit(1)).alias("points"))


def quoted(c: Column) -> Column:
    """Text in quotes, ``None`` for NULL."""
    escaped = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return (
        F.when(c.isNull(), "None")
        .when(c.contains("'") & ~c.contains('"'), F.concat(F.lit('"'), escaped, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def build_findings(flagged_points: DataFrame, check: str = K.POSTCODE_CHECK) -> DataFrame:
    """(check_name, entity_id, message, details) of flagged points; NULLs stay in the JSON."""
    message = F.concat(
        F.lit("Feed postcode "), quoted(F.col("postcode")), F.lit(" (area "), quoted(F.col("feed_area")),
        F.lit(") — "), lookup(F.col("verdict"), K.VERDICT_TEXT, F.col("verdict")), F.lit("."),
    )
    details = F.struct(
        "verdict", "site_name", F.col("postcode").alias("feed_postcode"), "feed_area",
        "coord_postcode", "coord_area",
    )
    return flagged_points.select(
        F.lit(check).alias("check_name"), F.col("cp_id").alias("entity_id"), message.alias("message"),
        F.to_json(details, {"ignoreNullFields": "false"}).alias("details"),
    )


def merge_findings(register: DataFrame, findings: DataFrame, now: Column,
                   check: str = K.POSTCODE_CHECK) -> DataFrame:
    """The register after a run of one check.

    New finding: opened.  Resolved but found again: reopened with fresh text, first
    detection kept.  Open or dismissed and found again: untouched.  Open and no longer
    found: resolved.  Other checks: untouched.  The result is a complete new register, to be
    written to a new place.
    """
    mine = register.where(F.col("check_name") == check)
    others = register.where(~F.col("check_name").eqNullSafe(F.lit(check)))
    seen = findings.select("entity_id", F.col("message").alias("new_message"),
                           F.col("details").alias("new_details"), F.lit(True).alias("seen"))
    both = mine.withColumn("stored", F.lit(True)).join(seen, "entity_id", "full")
    is_seen = F.col("seen").isNotNull()
    is_new = F.col("stored").isNull()
    reopened = is_seen & F.coalesce(F.col("status") == RESOLVED, F.lit(False))
    closed = ~is_seen & F.coalesce(F.col("status") == OPEN, F.lit(False))
    refresh = is_new | reopened
    merged = both.select(
        F.lit(check).alias("check_name"), "entity_id",
        F.when(refresh, F.col("new_message")).otherwise(F.col("message")).alias("message"),
        F.when(refresh, F.col("new_details")).otherwise(F.col("details")).alias("details"),
        F.when(refresh, OPEN).when(closed, RESOLVED).otherwise(F.col("status")).alias("status"),
        F.when(is_new, now).otherwise(F.col("detected_at")).alias("detected_at"),
        F.when(refresh, F.lit(None)).when(closed, now).otherwise(F.col("resolved_at")).alias("resolved_at"),
    )
    return merged.unionByName(others.select(*merged.columns))


def dismiss(register: DataFrame, entity_ids: DataFrame, now: Column, check: str = K.POSTCODE_CHECK) -> DataFrame:
    """The register with the given entities of one check dismissed."""
    chosen = entity_ids.select("entity_id").distinct().withColumn("chosen", F.lit(True))
    hit = F.col("chosen").isNotNull() & (F.col("check_name") == check)
    return (
        register.join(chosen, "entity_id", "left")
        .withColumns({
            "status": F.when(hit, DISMISSED).otherwise(F.col("status")),
            "resolved_at": F.when(hit, now).otherwise(F.col("resolved_at")),
        })
        .select(*[f.name for f in schemas.FINDINGS])
    )
