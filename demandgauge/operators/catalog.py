"""Pages to a catalog of session files, and its completeness."""

from __future__ import annotations

import datetime
import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions.frames import computed_once
from ..functions.periods import (
    filename_period, is_session_link, month_from_text, month_in_name, resolve_period, upload_period,
)
from ..functions.text import basename, lookup, strip
from ..session import materialise

_HEADING = r"(?is)<h([2-4])\b[^>]*>(.*?)</h\1\s*>"
_HREF = r"""\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_LINK = r"(?is)<a\b[^>]*?" + _HREF + r"[^>]*>.*?</a\s*>"
_TAGS = r"(?s)<!--.*?-->|<[^>]*>"

# The named references of the HTML standard, as the standard library holds them; those without a
# semicolon are the old ones that browsers also read unfinished.  A no-break space counts as a space.
_NAMED = {name: text.replace("\u00a0", " ") for name, text in html5.items()}
_OLD = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_NUMBER = "#[0-9]+;?|#[xX][0-9a-fA-F]+;?"
_IN_TEXT = f"&(?:{_NUMBER}|[A-Za-z][A-Za-z0-9]{{1,31}};|(?:{_OLD}))"
_IN_ADDRESS = f"&(?:{_NUMBER}|[A-Za-z][A-Za-z0-9]{{1,31}};|(?:{_OLD})(?![=A-Za-z0-9]))"
# Numbers that stand for the characters of Windows-1252, as the standard has it.
_WINDOWS = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def _of_number(ref: Column) -> Column:
    """The character of a numeric reference; U+FFFD when there is none of that number."""
    digits = F.regexp_replace(ref, "^&#|;$", "")
    hexadecimal = F.lower(digits).startswith("x")
    bare = F.regexp_replace(digits, "^[xX]?0*", "")
    n = F.when(F.length(bare) > 7, F.lit(-1)).when(hexadecimal, F.conv(bare, 16, 10).cast("int")).otherwise(bare.try_cast("int"))
    valid = ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n < 0x110000))
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (
        F.when(n == 160, F.lit(" ")).when((n >= 0x80) & (n < 0xA0), lookup(n.cast("string"), _WINDOWS, F.lit("")))
        .when(valid, plain).otherwise(F.lit("\ufffd")))


def _unescape(c: Column, in_address: bool = False) -> Column:
    """Character references decoded once, left to right, as the HTML standard has it.

    What a reference stands for is not read again.  Unknown names stay.  In an address an old name without
    semicolon counts only if neither ``=``, letter nor digit follows (``?a=1&copy=2``).
    """
    pattern = _IN_ADDRESS if in_address else _IN_TEXT
    table = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")

    def read(ref: Column) -> Column:
        known = F.try_element_at(table, F.substring(ref, F.lit(2), F.length(ref)))
        old = F.regexp_extract(ref, f"^&({_OLD})", 1)
        start = F.when(old != "", F.concat(F.try_element_at(table, old), F.substring(ref, F.length(old) + 2, F.length(ref))))
        named = F.coalesce(known, ref) if in_address else F.coalesce(known, start, ref)
        return F.when(ref.startswith("&#"), _of_number(ref)).otherwise(named)

    decoded = F.array_join(F.flatten(F.zip_with(
        F.split(c, pattern), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)),
        lambda piece, ref: F.array(piece, F.coalesce(read(ref), F.lit(""))))), "")
    return F.when(c.contains("&") & c.rlike(pattern), decoded).otherwise(c)


def _year_sections(html: Column) -> Column:
    """The page cut in front of every heading that names a year; each piece starts with that year.

    Two linear text passes inside the row, so no page is spread over rows to be put back in
    order: headings are first framed by control characters, then every framed heading is
    replaced by its year, or by nothing when it names none.
    """
    plain = F.translate(html, "\u0001\u0002\u0003", "")
    framed = F.split(F.regexp_replace(plain, _HEADING, "\u0001$2\u0002"), "\u0001")

    def marked(piece: Column) -> Column:
        heading = F.regexp_replace(F.substring_index(piece, "\u0002", 1), _TAGS, "")
        year = F.regexp_extract(heading, r"\b(20\d{2})\b", 1)
        return F.when(piece.contains("\u0002") & (year != ""), F.concat(F.lit("\u0003"), year, F.lit("\u0002"), piece)) \
            .otherwise(piece)

    return F.split(F.array_join(F.transform(framed, marked), "\u0001"), "\u0003")


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, text, heading_year) of every ``<a href>``, in document order.

    ``heading_year`` comes from the nearest heading (h2-h4) above that names a year.
    ``text`` is trimmed and lower-cased, without inner tags; character references are decoded once.
    """
    html = F.regexp_replace("html", "(?s)<!--.*?-->", "")
    sections = pages.select("page_id", F.posexplode(_year_sections(html)).alias("section_no", "section"))
    found = computed_once(sections, {
        "heading_year": F.regexp_extract("section", "^(20\\d{2})\u0002", 1).try_cast("int"),
        "links": F.regexp_extract_all("section", F.lit(_LINK), F.lit(0)),
    })
    links = found.select(
        "page_id", "section_no", "heading_year", F.posexplode("links").alias("link_no", "link"))
    # One pattern per part: the quoted or bare address, and the text left without any tag.
    quoted = F.regexp_extract("link", "(?is)" + _HREF, 1)
    href = F.when(quoted.rlike("^[\"']"), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(quoted)
    text = F.regexp_replace("link", _TAGS, "")
    read = computed_once(links, {"href": _unescape(href, in_address=True), "text": F.lower(strip(_unescape(text)))})
    return read.select(
        "page_id", F.struct("section_no", "link_no").alias("pos"), "href", "text", "heading_year")


def session_links(links: DataFrame) -> DataFrame:
    """B2: the links that lead to session files."""
    return links.where(is_session_link(F.col("href"), F.col("text")))


def resolve_links(links: DataFrame) -> DataFrame:
    """Session links with their year and month; links without a period drop."""
    href, text, name = F.col("href"), F.col("text"), F.col("_name")
    read = computed_once(links.withColumn("_name", basename(href)), {
        "_named": filename_period(name), "_upload": upload_period(href),
        "_text_month": month_from_text(text), "_name_month": month_in_name(name),
    })
    resolved = computed_once(read, {"_period": resolve_period(
        *[F.col(c) for c in ("_named", "_upload", "_text_month", "_name_month", "heading_year")])})
    return resolved.where(F.col("_period").isNotNull()).select(
        *links.columns, "_period.year", "_period.month")


def pick_preferred(links: DataFrame, keywords: list[str] | None = None,
                   keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One file per (page, year, month).

    In document order, a file replaces the current one when its name holds a keyword that
    the current one's name lacks.  With two keywords this order-dependent rule has a closed
    form, so no group is ever collected: the first file with both keywords wins; else, with
    one keyword each, the first file of the last-seen kind after the last one of the other
    kind; else the first file of all.  The links are read twice, so they are written once.
    Other numbers of keywords fold over the files of one page and month.
    """
    words = K.PREFERRED_KEYWORDS if keywords is None else keywords
    by = [*keys, "year", "month"]
    name = F.upper(basename(F.col("href")))
    if not 1 <= len(words) <= 2:
        return _fold_preferred(links, by, F.filter(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.contains(name, w)))
    has = [name.contains(w) for w in words] + [F.lit(False)] * (2 - len(words))
    kind = F.when(has[0] & has[1], "both").when(has[0], "one").when(has[1], "two").otherwise("none")
    ranked = materialise(links.select(*by, "pos", "href", kind.alias("kind")), "links")
    pos = F.col("pos")

    def of(k: str) -> Column:
        return F.when(F.col("kind") == k, pos)

    ends = ranked.groupBy(*by).agg(
        F.min(of("both")).alias("first_both"), F.max(of("one")).alias("last_one"),
        F.max(of("two")).alias("last_two"), F.min(pos).alias("first_any"),
    )
    last_is_one = F.coalesce(F.col("last_one") > F.col("last_two"), F.col("last_one").isNotNull())
    rule = ends.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.when(F.col("first_both").isNotNull(), "both")
        .when(F.col("last_one").isNull() & F.col("last_two").isNull(), "none")
        .when(last_is_one, "one").otherwise("two").alias("wanted"),
        F.when(F.col("first_both").isNotNull(), F.lit(None))
        .when(last_is_one, F.col("last_two")).otherwise(F.col("last_one")).alias("after"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    eligible = ranked.join(rule, [*same, F.col("kind") == F.col("wanted")]).where(
        F.col("after").isNull() | (pos > F.col("after")))
    return eligible.groupBy(*by).agg(F.min_by("href", "pos").alias("url"))


def _fold_preferred(links: DataFrame, by: list[str], held: Column) -> DataFrame:
    """The rule of ``pick_preferred`` step by step; ``held`` are the keywords in a file's name."""
    files = links.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "href", held.alias("held")))).alias("files"))
    chosen = F.aggregate("files", F.get("files", F.lit(0)), lambda now, f: F.when(F.size(F.array_except(f["held"], now["held"])) > 0, f).otherwise(now))
    return files.select(*by, chosen["href"].alias("url"))


def session_catalog(pages: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """(page_id, year, month, url) of a table of pages."""
    return pick_preferred(resolve_links(session_links(extract_links(pages))), keywords)


def month_calendar(spark: SparkSession, start: str = K.FIRST_MONTH, end: str = K.LAST_MONTH,
                   today: datetime.date | None = None) -> DataFrame:
    """(year, month) from ``start`` to the earlier of ``end`` and today."""
    last = F.least(F.lit(end).cast("date"), F.current_date() if today is None else F.lit(today))
    months = F.sequence(F.trunc(F.lit(start).cast("date"), "month"), last, F.expr("INTERVAL 1 MONTH"))
    return spark.range(1).select(F.explode(months).alias("d")).select(
        F.year("d").alias("year"), F.month("d").alias("month"))


def _month_number(prefix: str = "") -> Column:
    return F.col(f"{prefix}year") * 12 + F.col(f"{prefix}month")


def missing_months(available: DataFrame, calendar: DataFrame) -> DataFrame:
    """Expected months that are not available."""
    return calendar.join(available.select("year", "month").distinct(), ["year", "month"], "left_anti")


def completeness(available: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row with expected, available and missing counts, coverage in percent, gaps.

    Coverage may exceed 100, because months outside the calendar count as available.  A gap
    is a missing month between the first and the last available one.
    """
    have = available.select("year", "month").distinct().withColumn("a", F.lit(1))
    both = calendar.withColumn("e", F.lit(1)).join(have, ["year", "month"], "full")
    number = _month_number()
    stats = both.agg(
        F.count("e").alias("total_expected"), F.count("a").alias("total_available"),
        F.count_if(F.col("a").isNull()).alias("total_missing"),
        F.min(F.when(F.col("a") == 1, number)).alias("first"),
        F.max(F.when(F.col("a") == 1, number)).alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("a").isNull(), F.struct("year", "month")))).alias("missing"),
    )
    inside = F.exists("missing", lambda m: (m["year"] * 12 + m["month"] >= F.col("first"))
                      & (m["year"] * 12 + m["month"] <= F.col("last")))
    return stats.select(
        "total_expected", "total_available", "total_missing", "missing",
        F.when(F.col("total_expected") > 0, F.col("total_available") / F.col("total_expected") * 100)
        .otherwise(F.lit(100.0)).alias("coverage"),
        F.coalesce(inside, F.lit(False)).alias("has_gaps"),
    )


def missing_by_year(missing: DataFrame) -> DataFrame:
    """Missing months per year as short names in calendar order (at most twelve each)."""
    names = F.transform(F.array_sort(F.collect_set("month")),
                        lambda m: F.date_format(F.make_date(F.lit(2000), m, F.lit(1)), "MMM"))
    return missing.groupBy("year").agg(F.array_join(names, ", ").alias("months"))


def pending_downloads(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Catalog entries whose file is not in the landing zone (``file_name``) yet."""
    have = files.select("file_name").distinct()
    return catalog.withColumn("file_name", basename(F.col("url"))).join(have, "file_name", "left_anti")
