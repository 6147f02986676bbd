"""When sessions happen: hourly profiles, duration bands, trends.

Every operator takes grouping ``keys`` (none: all sessions together; ``["site_key"]``:
one result per site), so one job answers for every site at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.times import day_type, month_key


def sessions_of(sessions: DataFrame, cp_ids: DataFrame) -> DataFrame:
    """sessions at the given charge points (semi join; no text is built from ids)."""
    return sessions.join(cp_ids.select("cp_id"), "cp_id", "left_semi")


def duration_band(minutes: Column) -> Column:
    """label of the session-length band; NULL falls into the longest band."""
    band = F.lit(K.LONGEST_BAND)
    for limit, label in reversed(K.DURATION_BANDS):
        band = F.when(minutes < limit, label).otherwise(band)
    return band


def weekday_hour(sessions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """sessions by weekday (Monday = 0) and hour of start."""
    return sessions.groupBy(
        *(keys or []), F.weekday("start_time").alias("dow"), F.hour("start_time").alias("hour"),
    ).agg(F.count(F.lit(1)).alias("sessions"))


def day_counts(sessions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """distinct dates with at least one session, by day type."""
    return sessions.groupBy(*(keys or []), day_type(F.col("start_time")).alias("day_type")).agg(
        F.count_distinct(F.to_date("start_time")).alias("days"))


def hour_duration(sessions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """sessions by hour of start and session-length band."""
    return sessions.groupBy(
        *(keys or []), F.hour("start_time").alias("hour"),
        duration_band(F.col("duration_minutes")).alias("dur_band"),
    ).agg(F.count(F.lit(1)).alias("sessions"))


def monthly_trend(sessions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """sessions per month, in order."""
    by = [*(keys or []), "month"]
    return (
        sessions.groupBy(*(keys or []), month_key(F.col("start_time")).alias("month"))
        .agg(F.count(F.lit(1)).alias("sessions")).orderBy(*by)
    )


def dense_grid(counts: DataFrame, row: str, rows: list, keys: list[str] | None = None) -> DataFrame:
    """counts on the full grid of ``rows`` x 24 hours, 0 where nothing happened.

    At most ``len(rows) * 24`` counts exist per key, so they fit in one small map; the
    grid is then unfolded from that map, without a join.  ``row_no`` keeps the order of
    ``rows``.
    """
    cell = F.concat_ws("|", F.col(row).cast("string"), F.col("hour").cast("string"))
    known = counts.where(F.col(row).isin(rows) & F.col("hour").between(0, 23))
    cells = known.groupBy(*(keys or [])).agg(
        F.map_from_entries(F.collect_list(F.struct(cell, F.col("sessions")))).alias("_cells"))
    wanted = F.array(*[F.struct(F.lit(i).alias("row_no"), F.lit(r).alias(row))
                       for i, r in enumerate(rows)])
    return (
        cells.select(*(keys or []), "_cells", F.explode(wanted).alias("_row"))
        .select(*(keys or []), "_cells", "_row.*",
                F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
        .select(*(keys or []), "row_no", row, "hour",
                F.coalesce(F.element_at("_cells", cell), F.lit(0)).cast("long").alias("sessions"))
    )


def weekday_hour_grid(sessions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """dense 7 x 24 grid."""
    return dense_grid(weekday_hour(sessions, keys), "dow", list(range(7)), keys)


def hour_duration_grid(sessions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """dense 6 x 24 grid, longest band first."""
    return dense_grid(hour_duration(sessions, keys), "dur_band", K.BAND_ORDER, keys)


def wide_grid(grid: DataFrame, row: str, keys: list[str] | None = None) -> DataFrame:
    """one column per hour (``h0`` .. ``h23``)."""
    return grid.groupBy(*(keys or []), "row_no", row).agg(*[
        F.sum(F.when(F.col("hour") == h, F.col("sessions")).otherwise(0)).alias(f"h{h}")
        for h in range(24)
    ])


def average_profile(profile: DataFrame, days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """sessions per day of each day type and hour; a missing day count reads 1."""
    by = [*(keys or []), "day_type"]
    return (
        profile.withColumn("day_type", F.when(F.col("dow") >= 5, "Weekend").otherwise("Weekday"))
        .groupBy(*by, "hour").agg(F.sum("sessions").alias("sessions"))
        .join(days, by, "left")
        .select(*by, "hour", "sessions",
                (F.col("sessions") / F.coalesce("days", F.lit(1))).alias("avg_sessions"))
    )


def period(sessions: DataFrame) -> DataFrame:
    """F16: first and last start date."""
    return sessions.agg(F.to_date(F.min("start_time")).alias("date_min"),
                        F.to_date(F.max("start_time")).alias("date_max"))


def site_bundle(sessions: DataFrame, members: DataFrame) -> DataFrame:
    """trend, weekday profile, duration profile and day counts of every site, in one pass.

    Sessions are first counted per charge point, date, hour and band, so that only those
    counts meet the site list.  Output rows carry ``part`` (trend, profile, hour_duration,
    daycounts), the columns of that part, and ``n``.
    """
    per_point = sessions.groupBy(
        "cp_id", F.to_date("start_time").alias("date"), F.hour("start_time").alias("hour"),
        duration_band(F.col("duration_minutes")).alias("dur_band"),
    ).agg(F.count(F.lit(1)).alias("sessions"))
    shaped = per_point.join(members.select("site_key", "cp_id"), "cp_id").select(
        "site_key", "date", "hour", "dur_band", "sessions",
        F.date_format("date", "yyyy-MM").alias("month"), F.weekday("date").alias("dow"),
        day_type(F.col("date")).alias("day_type"),
    )
    counted = shaped.groupingSets(
        [[F.col("site_key"), F.col("month")],
         [F.col("site_key"), F.col("dow"), F.col("hour")],
         [F.col("site_key"), F.col("hour"), F.col("dur_band")],
         [F.col("site_key"), F.col("day_type"), F.col("date")]],
        "site_key", "month", "dow", "hour", "dur_band", "day_type", "date",
    ).agg(F.sum("sessions").alias("n"),
          *[F.grouping(c).alias(f"without_{c}") for c in ("month", "dow", "dur_band")])
    part = (
        F.when(F.col("without_month") == 0, "trend")
        .when(F.col("without_dow") == 0, "profile")
        .when(F.col("without_dur_band") == 0, "hour_duration")
        .otherwise("daycounts")
    )
    # The last set has one row per date, so counting its dates gives the distinct days.
    one_date = F.col("date").isNotNull().cast("int")
    return (
        counted.withColumn("part", part)
        .groupBy("site_key", "part", "month", "dow", "hour", "dur_band", "day_type")
        .agg(F.sum(F.when(F.col("part") == "daycounts", one_date).otherwise(F.col("n"))).alias("n"))
    )
