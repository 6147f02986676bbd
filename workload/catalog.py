"""Queries on pages, links, file names and months."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, functions as F

from demandgauge import constants as K
from demandgauge.functions import periods as Pd
from demandgauge.functions.frames import computed_once
from demandgauge.functions.text import basename
from demandgauge.operators import catalog as B
from demandgauge.operators.metrics import harvest_alerts

from . import inputs as I


def links(spark, d) -> DataFrame:
    """Orders as links of pages: file names in six styles, link texts in five."""
    k, when = F.col("o_orderkey"), F.col("o_orderdate")
    up = F.add_months(F.to_date(when), (k % 4).cast("int"))
    folder = F.when(k % 7 == 0, F.lit("https://files.example/")).otherwise(
        F.concat(F.lit("https://files.example/uploads/"), F.date_format(up, "yyyy/MM"), F.lit("/")))
    mon, mon_full = F.upper(F.date_format(when, "MMM")), F.upper(F.date_format(when, "MMMM"))
    yy, yyyy = F.date_format(when, "yy"), F.date_format(when, "yyyy")
    style = k % 6
    name = (
        F.when(style == 0, F.concat(mon, F.lit("-"), yy, F.lit("-SESSIONS.xlsx")))
        .when(style == 1, F.concat(F.lit("Sessions-"), mon, F.lit("-"), yyyy, F.lit(".CSV")))
        .when(style == 2, F.concat(mon, F.lit("-SESSIONS-NEW.xlsx")))
        .when(style == 3, F.concat(mon_full, F.lit("-SESSIONS-CLEAN.csv")))
        .when(style == 4, F.concat(F.lit("report_"), mon_full, F.lit("_"), yyyy, F.lit("_sessions_NEW_CLEAN.xlsx")))
        .otherwise(F.concat(F.lit("data-"), (k % 50).cast("string"), F.lit(".xlsx")))
    )
    word = F.lower(F.date_format(when, "MMMM"))
    text = (
        F.when(k % 5 == 0, F.concat(word, F.lit(" sessions")))
        .when(k % 5 == 1, F.concat(word, F.lit(" session download")))
        .when(k % 5 == 2, word).when(k % 5 == 3, "sessions").otherwise("annual report")
    )
    return computed_once(I.table(spark, d, "orders"), {
        "page_id": F.col("o_custkey") % 20, "pos": k, "href": F.concat(folder, name), "text": text,
        "heading_year": F.when(k % 3 == 0, F.year(when)).cast("int"),
    }).select("page_id", "pos", "href", "text", "heading_year")


_PAT = "(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*"
_MON = "(position({x} IN 'JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC') + 2) // 3"
_MONTH_WORDS = "|".join(K.MONTHS)
_IN_NAME = "coalesce(" + ", ".join(
    f"CASE WHEN contains(fu, '{m.upper()}') THEN {n} END" for m, n in K.MONTHS.items()) + ")"
_TEXT_MONTH = "CASE regexp_extract(lower(text), '^(" + _MONTH_WORDS + ")', 1) " + " ".join(
    f"WHEN '{m}' THEN {n}" for m, n in K.MONTHS.items()) + " END"
LINKS_SQL = f"""
links AS (
  SELECT o_custkey % 20 AS page_id, o_orderkey AS pos,
         CASE WHEN o_orderkey % 7 = 0 THEN 'https://files.example/'
              ELSE 'https://files.example/uploads/'
                   || strftime(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 4 AS INTEGER)), '%Y/%m') || '/' END
         || CASE o_orderkey % 6
              WHEN 0 THEN upper(strftime(o_orderdate, '%b')) || '-' || strftime(o_orderdate, '%y') || '-SESSIONS.xlsx'
              WHEN 1 THEN 'Sessions-' || upper(strftime(o_orderdate, '%b')) || '-' || strftime(o_orderdate, '%Y') || '.CSV'
              WHEN 2 THEN upper(strftime(o_orderdate, '%b')) || '-SESSIONS-NEW.xlsx'
              WHEN 3 THEN upper(strftime(o_orderdate, '%B')) || '-SESSIONS-CLEAN.csv'
              WHEN 4 THEN 'report_' || upper(strftime(o_orderdate, '%B')) || '_' || strftime(o_orderdate, '%Y') || '_sessions_NEW_CLEAN.xlsx'
              ELSE 'data-' || (o_orderkey % 50) || '.xlsx' END AS href,
         CASE o_orderkey % 5 WHEN 0 THEN lower(strftime(o_orderdate, '%B')) || ' sessions'
              WHEN 1 THEN lower(strftime(o_orderdate, '%B')) || ' session download'
              WHEN 2 THEN lower(strftime(o_orderdate, '%B')) WHEN 3 THEN 'sessions' ELSE 'annual report' END AS text,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS heading_year
  FROM orders
),
named AS (
  SELECT *, regexp_extract(href, '([^/]*)$', 1) AS file, upper(regexp_extract(href, '([^/]*)$', 1)) AS fu FROM links
),
parts AS (
  SELECT *, nullif(regexp_extract(fu, '{_PAT}-(\\d{{2,4}})', 1), '') AS m1,
         TRY_CAST(regexp_extract(fu, '{_PAT}-(\\d{{2,4}})', 2) AS INTEGER) AS y1,
         nullif(regexp_extract(fu, '{_PAT}[_-](\\d{{4}})', 1), '') AS m2,
         TRY_CAST(regexp_extract(fu, '{_PAT}[_-](\\d{{4}})', 2) AS INTEGER) AS y2,
         TRY_CAST(regexp_extract(href, '/uploads/(\\d{{4}})/(\\d{{2}})/', 1) AS INTEGER) AS uy,
         TRY_CAST(regexp_extract(href, '/uploads/(\\d{{4}})/(\\d{{2}})/', 2) AS INTEGER) AS um,
         {_TEXT_MONTH} AS tm, {_IN_NAME} AS nm,
         regexp_matches(href, '(?i)\\.(xlsx|csv)$')
           AND (regexp_matches(text, '^(\\w+)\\s+sessions?(\\s+download)?$')
                OR (contains(lower(file), 'session')
                    AND (regexp_matches(text, '^({_MONTH_WORDS})$') OR text = 'sessions'))) AS is_session
  FROM named
),
dated AS (
  SELECT *, CASE WHEN m1 IS NOT NULL THEN CASE WHEN y1 < 100 THEN y1 + 2000 ELSE y1 END ELSE y2 END AS fy,
         {_MON.format(x='coalesce(m1, m2)')} AS fm, coalesce(tm, nm) AS am
  FROM parts
),
resolved AS (
  SELECT *,
         CASE WHEN fy IS NOT NULL AND uy IS NULL THEN fy
              WHEN fy IS NOT NULL THEN CASE WHEN fm > um THEN uy - 1 ELSE uy END
              WHEN heading_year IS NOT NULL AND tm IS NOT NULL THEN heading_year
              WHEN uy IS NOT NULL AND am IS NOT NULL THEN CASE WHEN am > um THEN uy - 1 ELSE uy END END AS year,
         CASE WHEN fy IS NOT NULL THEN fm
              WHEN heading_year IS NOT NULL AND tm IS NOT NULL THEN tm
              WHEN uy IS NOT NULL AND am IS NOT NULL THEN am END AS month
  FROM dated
),
periods AS (SELECT * FROM resolved WHERE is_session AND year IS NOT NULL)"""
_WITH = f"WITH {LINKS_SQL}"


def _split(df: DataFrame, column, *keys: str) -> DataFrame:
    """Year and month of a period column; missing ones as text so that both engines agree on the type."""
    return df.select(*keys, column.alias("p")).select(
        *keys, F.col("p.year").cast("string").alias("year"), F.col("p.month").cast("string").alias("month"))


def extract_links(spark, d):
    found = B.extract_links(I.table(spark, d, "pages"))
    return found.select("page_id", F.col("pos.link_no").alias("link_no"), "href", "text")


def link_references(spark, d):
    """Customers as pages of one link each, with character references of all kinds in address and text."""
    k, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 7
    address = (
        F.when(kind == 0, "a&#38;lt;b").when(kind == 1, "?a=1&copy=2&amp;b=3").when(kind == 2, "&eacute;.csv").when(kind == 3, "x&#x26;y&#128;")
        .when(kind == 4, "?a&lt=1&unknown;").when(kind == 5, "&amp;amp;").otherwise("plain"))
    text = (
        F.when(kind == 0, "a&#38;lt;b").when(kind == 1, "May &copy 2024&nbsp;").when(kind == 2, "Caf&eacute; &hellip;").when(kind == 3, "&#0;&#xD800;&#1114112;z")
        .when(kind == 4, "&unknown; &notit; &ampx").when(kind == 5, "&amp;amp;&NotEqualTilde;").otherwise("&Eacute;t&#233; & &;"))
    pages = I.table(spark, d, "customer").select(
        F.col("c_custkey").alias("page_id"), F.concat(F.lit('<a href="'), address, F.lit("/"), k, F.lit('">'), text, F.lit(" "), k, F.lit("</a>")).alias("html"))
    return B.extract_links(pages).select("page_id", "href", "text")


def session_links(spark, d):
    return B.session_links(links(spark, d)).select("pos", "href", "text")


def filename_period(spark, d):
    return _split(links(spark, d), Pd.filename_period(basename(F.col("href"))), "pos")


def upload_period(spark, d):
    return _split(links(spark, d), Pd.upload_period(F.col("href")), "pos")


def infer_year(spark, d):
    read = computed_once(links(spark, d), {
        "upload": Pd.upload_period(F.col("href")), "month": Pd.month_in_name(basename(F.col("href")))})
    return read.where("upload IS NOT NULL AND month IS NOT NULL").select("pos", Pd.infer_year(F.col("month"), F.col("upload")).alias("year"))


def text_month(spark, d):
    return links(spark, d).select(
        "pos", Pd.month_from_text(F.col("text")).cast("string").alias("text_month"),
        Pd.month_in_name(basename(F.col("href"))).cast("string").alias("name_month"))


def heading_pages(spark, d) -> DataFrame:
    """One page per order with headings that name a year, one that does not, and links between."""
    k, y = F.col("o_orderkey").cast("string"), F.year("o_orderdate")
    html = F.concat(
        F.lit('<p><a class=x href="/a/'), k, F.lit('.csv">before</a></p><H2 id="1999">Data <b>'), y.cast("string"),
        F.lit('</b></H2><ul><li><a href=\'/b/'), k, F.lit('.csv\'> May  Sessions </a></li></ul><h3>Other files</h3>'
                                                        '<a href=/c/'), k,
        F.lit('.csv><span>June</span></a><h1>2031</h1><h4>&amp; year '), (y + 1).cast("string"),
        F.lit(' now</h4><a name="x">no link</a><a target="_blank" href="/d/'), k, F.lit('.csv?a=1&amp;b=2">Sessions</a>'),
    )
    return I.table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), html.alias("html"))


def heading_year(spark, d):
    return B.extract_links(heading_pages(spark, d)).select(
        "page_id", "href", "text", F.col("heading_year").cast("string").alias("heading_year"))


def resolve_period(spark, d):
    return B.resolve_links(B.session_links(links(spark, d))).select("pos", "href", "year", "month")


def preferred_file(spark, d):
    return B.pick_preferred(B.resolve_links(B.session_links(links(spark, d))))


def _available(spark, d) -> DataFrame:
    """Months with orders, with holes: every seventh month counts as absent."""
    o = I.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return o.where((F.col("year") * 12 + F.col("month")) % 7 != 3)


def _calendar(spark):
    return B.month_calendar(spark, "1995-03-15", "2030-12-31", datetime.date(1999, 2, 10))


_CALENDAR_SQL = """
calendar AS (
  SELECT CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month
  FROM (SELECT unnest(generate_series(DATE '1995-03-01', DATE '1999-02-10', INTERVAL 1 MONTH)) AS m)
),
available AS (
  SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month
  FROM orders WHERE (year(o_orderdate) * 12 + month(o_orderdate)) % 7 <> 3
),
missing AS (SELECT * FROM calendar EXCEPT SELECT * FROM available),
report AS (
  SELECT (SELECT count(*) FROM calendar) AS total_expected, (SELECT count(*) FROM available) AS total_available,
         (SELECT count(*) FROM missing) AS total_missing,
         (SELECT count(*) FROM available) / (SELECT count(*) FROM calendar)::DOUBLE * 100 AS coverage,
         EXISTS (SELECT 1 FROM missing WHERE year * 12 + month BETWEEN (SELECT min(year * 12 + month) FROM available)
                                                             AND (SELECT max(year * 12 + month) FROM available)) AS has_gaps
)"""


def missing_months(spark, d):
    return B.missing_months(_available(spark, d), _calendar(spark))


def completeness(spark, d):
    return B.completeness(_available(spark, d), _calendar(spark)).drop("missing", "has_gaps")


def has_gaps(spark, d):
    return B.completeness(_available(spark, d), _calendar(spark)).select("has_gaps")


def missing_by_year(spark, d):
    return B.missing_by_year(B.missing_months(_available(spark, d), _calendar(spark)))


def harvest_alerts_query(spark, d):
    recent = _available(spark, d).where("year >= 1997 AND year < 1999")
    report = B.completeness(recent, _calendar(spark))
    return harvest_alerts(report.withColumn("failed", F.col("total_missing")))


def to_fetch(spark, d):
    files = links(spark, d).where("pos % 2 = 0").select(basename(F.col("href")).alias("file_name"))
    catalog = links(spark, d).select("pos", F.col("href").alias("url"))
    return B.pending_downloads(catalog, files).select("pos", "url")


QUERIES = {
    "extract_links": extract_links,
    "link_references": link_references,
    "session_links": session_links,
    "filename_period": filename_period,
    "upload_period": upload_period,
    "infer_year": infer_year,
    "text_month": text_month,
    "heading_year": heading_year,
    "resolve_period": resolve_period,
    "preferred_file": preferred_file,
    "missing_months": missing_months,
    "completeness": completeness,
    "has_gaps": has_gaps,
    "missing_by_year": missing_by_year,
    "harvest_alerts": harvest_alerts_query,
    "to_fetch": to_fetch,
}

_A = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))[^>]*>(.*?)</a\s*>"""
_UNESCAPE = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"

ORACLE = {
    "extract_links": f"""
WITH found AS (
  SELECT page_id, regexp_extract_all(html, '{_A}') AS l FROM pages
),
each AS (SELECT page_id, unnest(l) AS link, unnest(generate_series(0, len(l) - 1)) AS link_no FROM found)
SELECT page_id, CAST(link_no AS INTEGER) AS link_no,
       {_UNESCAPE.format(x=f"(regexp_extract(link, '{_A}', 1) || regexp_extract(link, '{_A}', 2) || regexp_extract(link, '{_A}', 3))")} AS href,
       lower(trim({_UNESCAPE.format(x=f"regexp_replace(regexp_extract(link, '{_A}', 4), '<[^>]*>', '', 'g')")})) AS text
FROM each""",
    "link_references": """
SELECT c_custkey AS page_id,
       CASE c_custkey % 7 WHEN 0 THEN 'a&lt;b' WHEN 1 THEN '?a=1&copy=2&b=3' WHEN 2 THEN 'é.csv' WHEN 3 THEN 'x&y€'
            WHEN 4 THEN '?a&lt=1&unknown;' WHEN 5 THEN '&amp;' ELSE 'plain' END || '/' || c_custkey AS href,
       CASE c_custkey % 7 WHEN 0 THEN 'a&lt;b' WHEN 1 THEN 'may © 2024 ' WHEN 2 THEN 'café …'
            WHEN 3 THEN repeat(chr(65533), 3) || 'z' WHEN 4 THEN '&unknown; ¬it; &x'
            WHEN 5 THEN '&amp;' || chr(8770) || chr(824) ELSE 'été & &;' END || ' ' || c_custkey AS text
FROM customer""",
    "session_links": _WITH + " SELECT pos, href, text FROM parts WHERE is_session",
    "filename_period": _WITH + """
SELECT pos, CAST(fy AS VARCHAR) AS year, CASE WHEN fy IS NOT NULL THEN CAST(fm AS VARCHAR) END AS month FROM dated""",
    "upload_period": _WITH + " SELECT pos, CAST(uy AS VARCHAR) AS year, CAST(um AS VARCHAR) AS month FROM parts",
    "infer_year": _WITH + """
SELECT pos, CASE WHEN nm > um THEN uy - 1 ELSE uy END AS year FROM parts WHERE uy IS NOT NULL AND nm IS NOT NULL""",
    "text_month": _WITH + """
SELECT pos, CAST(tm AS VARCHAR) AS text_month, CAST(nm AS VARCHAR) AS name_month FROM parts""",
    "heading_year": """
SELECT o_orderkey AS page_id, '/a/' || o_orderkey || '.csv' AS href, 'before' AS text, NULL AS heading_year FROM orders
UNION ALL SELECT o_orderkey, '/b/' || o_orderkey || '.csv', 'may  sessions', CAST(year(o_orderdate) AS VARCHAR) FROM orders
WHERE year(o_orderdate) >= 2000
UNION ALL SELECT o_orderkey, '/b/' || o_orderkey || '.csv', 'may  sessions', NULL FROM orders WHERE year(o_orderdate) < 2000
UNION ALL SELECT o_orderkey, '/c/' || o_orderkey || '.csv', 'june',
       CASE WHEN year(o_orderdate) >= 2000 THEN CAST(year(o_orderdate) AS VARCHAR) END FROM orders
UNION ALL SELECT o_orderkey, '/d/' || o_orderkey || '.csv?a=1&b=2', 'sessions',
       CASE WHEN year(o_orderdate) >= 1999 THEN CAST(year(o_orderdate) + 1 AS VARCHAR) END FROM orders""",
    "resolve_period": _WITH + """
SELECT pos, href, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month FROM periods""",
    "preferred_file": _WITH + """,
kinds AS (
  SELECT page_id, year, month, list({'url': href, 'c': contains(fu, 'CLEAN'), 'n': contains(fu, 'NEW')} ORDER BY pos) AS l
  FROM periods GROUP BY ALL
)
SELECT page_id, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month,
       list_reduce(l, lambda a, x: CASE WHEN (x.c AND NOT a.c) OR (x.n AND NOT a.n) THEN x ELSE a END).url AS url
FROM kinds""",
    "missing_months": f"WITH {_CALENDAR_SQL} SELECT * FROM missing",
    "completeness": f"WITH {_CALENDAR_SQL} SELECT total_expected, total_available, total_missing, coverage FROM report",
    "has_gaps": f"WITH {_CALENDAR_SQL} SELECT has_gaps FROM report",
    "missing_by_year": f"""WITH {_CALENDAR_SQL}
SELECT year, string_agg(strftime(make_date(2000, month, 1), '%b'), ', ' ORDER BY month) AS months
FROM missing GROUP BY year""",
    "harvest_alerts": f"""WITH {_CALENDAR_SQL},
recent AS (SELECT * FROM available WHERE year >= 1997 AND year < 1999),
n AS (SELECT (SELECT count(*) FROM recent) AS a, (SELECT count(*) FROM calendar) AS e,
             (SELECT count(*) FROM (SELECT * FROM calendar EXCEPT SELECT * FROM recent)) AS m)
SELECT 'coverage below 95 %' AS alert FROM n WHERE a / e::DOUBLE * 100 < 95
UNION ALL SELECT m || ' file downloads failed' FROM n WHERE m > 0""",
    "to_fetch": _WITH + """
SELECT pos, href AS url FROM named WHERE file NOT IN (SELECT file FROM named WHERE pos % 2 = 0)""",
}
