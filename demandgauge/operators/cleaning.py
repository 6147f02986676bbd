"""Session normalisation and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import constants as K, schemas
from ..functions.numbers import to_double
from ..functions.text import clean_id, connector_type, is_missing_id, site_title
from ..functions.times import add_minutes, duration_minutes, month_key, parse_uk_timestamp
from .metrics import RunMetrics, null_counts

SESSION_KEY = ["cp_id", "connector", "start_time", "consumption_kwh"]


def typed_sessions(raw: DataFrame) -> DataFrame:
    """Typed columns from raw text; text that cannot be read becomes NULL.

    ``raw`` has the raw session columns, ``has_end_time`` (does the file state end times?)
    and whatever else should be carried along.
    """
    return raw.withColumns({
        "cp_id": clean_id(F.col("cp_id")),
        "connector": clean_id(F.col("connector")),
        "start_time": parse_uk_timestamp(F.col("start_time")),
        "consumption_kwh": to_double(F.col("consumption_kwh")),
        "amount": to_double(F.col("amount")),
        "duration_minutes": duration_minutes(F.col("duration")),
        "end_time": parse_uk_timestamp(F.col("end_time")),
    }).withColumn("end_time", derive_end()).drop("duration", "has_end_time")


def derive_end() -> Column:
    """The stated end where the file has end times (NULL stays NULL), else start + duration."""
    return F.when(F.col("has_end_time"), F.col("end_time")).otherwise(
        add_minutes(F.col("start_time"), F.col("duration_minutes")))


def dedup_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``; NULL keys are equal to each other.

    Spark limits each key to its first row before the shuffle (``WindowGroupLimit``), so a key with
    very many copies stays cheap and no row is packed into a struct and out again.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last()))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def drop_missing_ids(df: DataFrame, ids: tuple[str, ...] = ("cp_id", "connector")) -> DataFrame:
    """C14: rows with a usable charge point and connector."""
    for c in ids:
        df = df.where(~is_missing_id(F.col(c)))
    return df


def is_valid_session() -> Column:
    """C17: energy and duration within limits and an end after the start; NULL is invalid."""
    kwh, minutes = F.col("consumption_kwh"), F.col("duration_minutes")
    return (
        (kwh > 0) & (kwh <= K.MAX_CONSUMPTION_KWH)
        & (minutes > K.MIN_DURATION_MINUTES) & (minutes <= K.MAX_DURATION_MINUTES)
        & (F.col("end_time") > F.col("start_time"))
    )


def enforce_not_null(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Drop rows that lack a required column (those present in ``df``)."""
    return df.na.drop(subset=[c for c in schemas.required_columns(schema) if c in df.columns])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in order and type."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def clean_sessions(
    typed: DataFrame,
    order: str = "row_order",
    metrics: RunMetrics | None = None,
    now: Column | None = None,
    valid_first: bool = False,
) -> DataFrame:
    """Deduplicate, drop unusable rows, tidy text, conform to the session schema.

    Duplicates are removed before the validity check, so a bad first copy hides a later
    good one; ``valid_first`` turns that round.
    """
    metrics = metrics or RunMetrics()
    df = metrics.watch(typed, "read", **null_counts(["start_time", "consumption_kwh", "duration_minutes"]))
    if valid_first:
        df = df.where(is_valid_session())
    df = metrics.watch(dedup_first(df, SESSION_KEY, order), "deduplicated")
    df = metrics.watch(drop_missing_ids(df), "identified")
    df = df.withColumns({
        "site_name": site_title(F.col("site_name")),
        "connector_type": connector_type(F.col("connector_type")),
    })
    df = metrics.watch(df.where(is_valid_session()), "valid")
    df = df.withColumns({
        "ingested_at": F.current_timestamp() if now is None else now,
        "year_month": month_key(F.col("start_time")),
    })
    df = enforce_not_null(df, schemas.SESSIONS)
    return metrics.watch(
        conform(df, schemas.SESSIONS), "written",
        months=F.array_sort(F.collect_set("year_month")),
    )


def without_known(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Sessions whose key the stored table does not hold yet (optional, across batches)."""
    known = stored.select(*SESSION_KEY).distinct()
    return df.join(known, SESSION_KEY, "left_anti")


def months_covered(sessions: DataFrame) -> DataFrame:
    """Distinct months, sorted."""
    return sessions.select("year_month").distinct().orderBy("year_month")
