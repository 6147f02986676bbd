"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import CONNECTOR_TYPES, MISSING_IDS, POWER_TYPES


# All characters that count as white space.
_WHITE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """Value of ``key`` in a small literal table, else ``default`` (NULL when not given)."""
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    found = F.element_at(pairs, key)
    return found if default is None else F.coalesce(found, default)


def strip(c: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.btrim(c, F.lit(_WHITE))


def clean_id(c: Column) -> Column:
    """Identifier as trimmed text; digits keep their leading zeros."""
    return strip(c.cast("string"))


def is_missing_id(c: Column) -> Column:
    """C14: NULL or a spelling that stands for a missing identifier."""
    return c.isNull() | F.lower(c).isin(MISSING_IDS)


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest.

    ``initcap`` alone starts words at blanks only.  A marked blank is put behind every other
    non-letter and taken out again, so ``st john's`` becomes ``St John'S``.
    """
    split = F.regexp_replace(c, r"([^\p{Lu}\p{Ll}\p{Lt} ])(?=[\p{Lu}\p{Ll}\p{Lt}])", "$1\u0001 ")
    return F.replace(F.initcap(split), F.lit("\u0001 "), F.lit(""))


def site_title(c: Column) -> Column:
    """C15 for site names: trimmed and title-cased, NULL kept."""
    return title_case(strip(c))


def connector_type(c: Column) -> Column:
    """Known spellings by table, others title-cased, NULL kept."""
    text = strip(c)
    return lookup(F.lower(text), CONNECTOR_TYPES, title_case(text))


def power_type(c: Column) -> Column:
    """Feed power code to AC/DC; unknown codes unchanged."""
    return lookup(c, POWER_TYPES, c)


def basename(path: Column) -> Column:
    """Last element of a slash-separated path or URL."""
    return F.substring_index(path, "/", -1)


def postcode_area(c: Column) -> Column:
    """One or two leading letters of a postcode, NULL when there are none."""
    return F.nullif(F.regexp_extract(F.upper(strip(c)), r"^([A-Z]{1,2})", 1), F.lit(""))


def json_object_text(text: Column) -> Column:
    """The text from the first ``{`` to the last ``}``, NULL when absent."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
