"""Column expressions over timestamps, dates and durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import to_double
from .text import strip

_DAY_FIRST = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})(?=\D|$)[T ]*"
_SHORT_YEAR = r"^(\d+/\d+/)(\d\d)(?!\d)"
_YEAR_FIRST = r"^\d{4}-\d{1,2}-\d{1,2}"
_CLOCK = r"^(?:\d+ days?,? )?\d+:\d{1,2}:\d{1,2}(?:\.\d+)?$"


def parse_uk_timestamp(c: Column) -> Column:
    """Day-first dates (also with AM/PM or a month name), else year-first text; anything else is NULL.

    Year-first text is never read day-first, so ``2024-03-04`` is 4 March.
    """
    text = _usual_order(strip(c.cast("string")))
    slashed = F.rtrim(F.regexp_replace(text, _DAY_FIRST, "$1/$2/$3 "))
    full_year = F.regexp_replace(slashed, _SHORT_YEAR, "$120$2")
    dashed = F.regexp_replace(text, r"^(\d{4})/(\d{1,2})/", "$1-$2-")
    # Month names: first letter large, the others small, three letters; AM and PM in capitals.
    named = F.regexp_replace(F.initcap(F.regexp_replace(text, "[-,. ]+(?=[A-Za-z0-9])", " ")), r"\b([A-Z][a-z]{2})[a-z]*\b", "$1")
    half_day = F.upper(F.regexp_replace(full_year, r"\s*([AaPp])\.?[Mm]\.?$", " $1M"))
    return F.when(dashed.rlike(_YEAR_FIRST), dashed.try_cast("timestamp")).when(
        text.rlike(r"(?i)\d\s*[ap]\.?m\.?$"), F.try_to_timestamp(half_day, F.lit("d/M/yyyy h:mm[:ss] a"))).when(
        text.rlike(r"^\d{1,2}[- ][A-Za-z]{3,9}[-, ]+\d{4}\b"), F.try_to_timestamp(named, F.lit("d MMM yyyy[ H:mm[:ss]]"))).otherwise(
        F.try_to_timestamp(full_year, F.lit("d/M/yyyy[ H:mm[:ss[.SSSSSS]]]")))


def _usual_order(text: Column) -> Column:
    """Weekdays in front dropped, ``March 4, 2024`` as ``4 March 2024``, ``20240304`` as ``2024-03-04``."""
    day = F.regexp_replace(text, r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.]?\s+", "")
    month_first = F.regexp_replace(day, r"^([A-Za-z]{3,9})\.? +(\d{1,2})(?:st|nd|rd|th)?,? +(\d{4})\b,?", "$2 $1 $3")
    compact = F.regexp_replace(month_first, r"^(\d{4})(\d{2})(\d{2})(?=\D|$)", "$1-$2-$3")
    return F.when(text.rlike(r"^[A-Za-z]|^\d{8}(?:\D|$)"), compact).otherwise(text)


def duration_minutes(c: Column) -> Column:
    """Bare numbers are seconds, else ``[N days ]HH:MM:SS[.f]``; other text is NULL.

    Decided value by value, so a column that mixes both forms is read correctly.
    """
    text = strip(c.cast("string"))

    clock = F.split(F.substring_index(text, " ", -1), ":")
    days = F.when(text.contains("day"), F.substring_index(text, " ", 1).cast("double")).otherwise(0.0)
    seconds = (
        days * 86400 + clock[0].cast("double") * 3600 + clock[1].cast("double") * 60 + clock[2].cast("double"))
    number = F.when(~text.rlike("(?i)inf"), to_double(text))
    return F.coalesce(number, F.when(text.rlike(_CLOCK), seconds)) / 60


def add_minutes(ts: Column, minutes: Column) -> Column:
    """Timestamp plus fractional minutes, to the microsecond."""
    return F.timestamp_micros(F.unix_micros(ts) + F.round(minutes * 60e6).cast("long"))


def end_or_planned(start: Column, end: Column, minutes: Column) -> Column:
    """The end time, else start plus duration counted from the start's whole second."""
    return F.coalesce(end, F.timestamp_seconds(F.unix_seconds(start) + minutes * 60))


def month_key(ts: Column) -> Column:
    """``yyyy-MM``."""
    return F.date_format(ts, "yyyy-MM")


def hours_between_seconds(start: Column, end: Column) -> Column:
    """Hours between two timestamps, each cut to whole seconds."""
    return (F.unix_seconds(end) - F.unix_seconds(start)) / 3600.0


def hours_between(start: Column, end: Column) -> Column:
    """Hours between two timestamps with their fractions of a second."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 3.6e9


def day_type(ts: Column) -> Column:
    """``Weekend`` for Saturday and Sunday, else ``Weekday``."""
    return F.when(F.weekday(ts) >= 5, "Weekend").otherwise("Weekday")
