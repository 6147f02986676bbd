"""Column expressions that read years and months out of file names, URLs and link texts.

A period is a struct (year, month), NULL when it cannot be told.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K
from .text import basename, lookup

_MONTH_WORD = "(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*"
_DASHED = _MONTH_WORD + r"-(\d{2,4})"
_FULL_YEAR = _MONTH_WORD + r"[_-](\d{4})"
_UPLOAD = r"/uploads/(\d{4})/(\d{2})/"
_SESSION_TEXT = r"^(\w+)\s+sessions?(\s+download)?$"


def period(year: Column, month: Column) -> Column:
    """(year, month) when both are known."""
    return F.when(year.isNotNull() & month.isNotNull(), _pair(year, month))


def _pair(year: Column, month: Column) -> Column:
    return F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"))


def is_session_link(href: Column, text: Column) -> Column:
    """B2: does a link (lower-cased, trimmed text) lead to a session file?"""
    split_link = F.lower(basename(href)).contains("session") & (
        text.isin(list(K.MONTHS)) | (text == "sessions"))
    return href.rlike(r"(?i)\.(xlsx|csv)$") & (text.rlike(_SESSION_TEXT) | split_link)


def filename_period(name: Column) -> Column:
    """``MONTH-YY`` or ``MONTH-YYYY``, else ``MONTH_YYYY``; two-digit years are 20YY."""
    upper = F.upper(name)

    def found(pattern: str) -> Column:
        digits = F.regexp_extract(upper, pattern, 2).try_cast("int")
        year = digits + F.when(digits < 100, 2000).otherwise(0)
        month = lookup(F.lower(F.regexp_extract(upper, pattern, 1)), K.MONTHS)
        return F.when(upper.rlike(pattern), _pair(year, month))

    return F.coalesce(found(_DASHED), found(_FULL_YEAR))


def upload_period(url: Column) -> Column:
    """Year and month of the ``/uploads/YYYY/MM/`` part."""
    return F.when(url.rlike(_UPLOAD), _pair(
        F.regexp_extract(url, _UPLOAD, 1).try_cast("int"), F.regexp_extract(url, _UPLOAD, 2).try_cast("int")))


def infer_year(month: Column, upload: Column) -> Column:
    """A month later than the upload month belongs to the year before."""
    return F.when(month > upload["month"], upload["year"] - 1).otherwise(upload["year"])


def month_from_text(text: Column) -> Column:
    """Month whose name starts the text."""
    word = F.regexp_extract(F.lower(text), "^(" + "|".join(K.MONTHS) + ")", 1)
    return lookup(word, K.MONTHS)


def month_in_name(name: Column) -> Column:
    """Earliest month of the year whose name occurs in a file name.

    Every full name contains its three-letter form, so one pattern finds them all.
    """
    found = F.regexp_extract_all(F.lower(name), F.lit("(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"))
    return F.array_min(F.transform(found, lambda m: lookup(m, K.MONTHS)))


def resolve_period(named: Column, upload: Column, text_month: Column, name_month: Column,
                   heading_year: Column) -> Column:
    """(1) file name, corrected by the upload path; (2) link text and heading; (3) any month
    and the upload path.  NULL when nothing fits.

    The arguments should be columns of an earlier step, so that each pattern is tried once.
    """
    any_month = F.coalesce(text_month, name_month)
    return F.coalesce(
        F.when(named.isNotNull() & upload.isNull(), named),
        F.when(named.isNotNull(), _pair(infer_year(named["month"], upload), named["month"])),
        period(heading_year, text_month),
        F.when(upload.isNotNull() & any_month.isNotNull(), _pair(infer_year(any_month, upload), any_month)),
    )
