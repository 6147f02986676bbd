import datetime

from pyspark.sql import functions as F
import random

import pytest

from demandgauge.operators import catalog as B
from demandgauge.plans.harvest_run import run_harvest

UP = "https://files.example/wp-content/uploads/"
PAGE = f"""<html><body><h2>Archive <b>2024</b></h2>
<p><a href="{UP}2024/03/Sessions-JAN-24.xlsx">January Sessions</a>
<a href='{UP}2023/12/Sessions-OCT-24.xlsx'>october session download</a></p>
<h3>Latest</h3>
<a href="{UP}2026/07/MAY-26-SESSIONS.xlsx"> May  Sessions </a>
<a href="{UP}2025/12/OCT-SESSIONS-NEW.xlsx">October Sessions</a>
<a href="{UP}2025/08/JUNE-SESSIONS-CPS.csv">June</a><a href="{UP}2025/08/JUNE-SESSIONS-CPS.csv">Sessions</a>
<a href="{UP}2026/02/NOV-SESSIONS.xlsx">Nov sessions</a>
<h2>Older: 2023</h2>
<a href="/files/data.xlsx">march sessions</a> <a href="/files/other.xlsx">sessions</a>
<a href="{UP}2023/05/report.pdf">april sessions</a> <a href="{UP}2023/05/APR-23.xlsx">annual report</a>
<a name="x">may sessions</a></body></html>"""


def links_of(spark, names, page=1):
    rows = [(page, i, f"/f/{n}", 2024, 1) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "page_id long, pos long, href string, year int, month int")


def test_page_to_catalog(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    links = B.extract_links(pages).orderBy("pos").collect()
    assert len(links) == 11 and links[2].text == "may  sessions"
    assert [r.heading_year for r in links] == [2024] * 7 + [2023] * 4
    got = {(r.year, r.month): r.url.rsplit("/", 1)[-1] for r in B.session_catalog(pages).collect()}
    assert got == {
        (2024, 1): "Sessions-JAN-24.xlsx", (2023, 10): "Sessions-OCT-24.xlsx", (2026, 5): "MAY-26-SESSIONS.xlsx",
        # without a year in the name the heading decides, and the upload path only after it
        (2024, 10): "OCT-SESSIONS-NEW.xlsx", (2024, 6): "JUNE-SESSIONS-CPS.csv", (2024, 11): "NOV-SESSIONS.xlsx",
        (2025, 6): "JUNE-SESSIONS-CPS.csv", (2023, 3): "data.xlsx",
    }
    no_headings = spark.createDataFrame([(1, PAGE.replace("h2", "p"))], "page_id long, html string")
    periods = {(r.year, r.month) for r in B.session_catalog(no_headings).collect()}
    assert {(2025, 10), (2025, 6), (2025, 11)} <= periods and (2023, 3) not in periods


def fold(names, keywords):
    best = names[0]
    for n in names[1:]:
        if any(k in n.upper() and k not in best.upper() for k in keywords):
            best = n
    return best


@pytest.mark.parametrize("keywords", [["CLEAN", "NEW"], ["NEW"], ["CLEAN", "NEW", "LEA", "1"], []])
def test_preferred_file_equals_the_fold(spark, keywords):
    rng = random.Random(11)
    groups = {g: [f"{rng.choice(['', 'clean', 'NEW', 'NEW-CLEAN', 'Clean_new', ''])}{i}.csv" for i in range(rng.randint(1, 9))]
              for g in range(120)}
    rows = [(g, i, f"/f/{n}", 2024, 1) for g, names in groups.items() for i, n in enumerate(names)]
    rng.shuffle(rows)
    links = spark.createDataFrame(rows, "page_id long, pos long, href string, year int, month int")
    got = {r.page_id: r.url[3:] for r in B.pick_preferred(links, keywords).collect()}
    assert got == {g: fold(names, keywords) for g, names in groups.items()}


def test_preferred_order_matters(spark):
    assert B.pick_preferred(links_of(spark, ["a-CLEAN.csv", "a-NEW.csv", "a.csv"])).first().url == "/f/a-NEW.csv"
    assert B.pick_preferred(links_of(spark, ["a-NEW.csv", "a.csv", "a-CLEAN.csv"])).first().url == "/f/a-CLEAN.csv"


def test_completeness(spark):
    calendar = B.month_calendar(spark, today=datetime.date(2030, 1, 1))
    assert calendar.count() == 44
    assert B.month_calendar(spark, today=datetime.date(2022, 12, 5)).count() == 3
    have = [(r.year, r.month) for r in calendar.collect() if (r.year, r.month) not in {(2024, 2), (2026, 5)}]
    report = B.completeness(spark.createDataFrame(have, "year int, month int"), calendar).first()
    assert report.has_gaps and [tuple(m) for m in report.missing] == [(2024, 2), (2026, 5)]
    assert round(report.coverage, 3) == round(42 / 44 * 100, 3)
    trailing = [m for m in have if m < (2024, 2)]
    report = B.completeness(spark.createDataFrame(trailing, "year int, month int"), calendar).first()
    assert not report.has_gaps
    extra = spark.createDataFrame([(r.year, r.month) for r in calendar.collect()] + [(2021, 1)], "year int, month int")
    report = B.completeness(extra, calendar).first()
    assert report.coverage > 100 and report.total_missing == 0 and not report.has_gaps
    none = B.completeness(extra.limit(0), calendar).first()
    assert none.coverage == 0 and not none.has_gaps


def test_harvest(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    calendar = B.month_calendar(spark, today=datetime.date(2030, 1, 1))
    files = spark.createDataFrame([("data.xlsx",)], "file_name string")
    h = run_harvest(pages, calendar, files, failed=2)
    assert h.pending.where("file_name = 'data.xlsx'").count() == 0 and h.pending.count() == 7
    assert {r.alert for r in h.alerts.collect()} == {"coverage below 95 %", "2 file downloads failed"}
    by_year = {r.year: r.months for r in B.missing_by_year(h.missing).collect()}
    assert by_year[2022] == "Oct, Nov, Dec" and by_year[2026] == "Jan, Feb, Mar, Apr"


def test_entities_and_comments(spark):
    from demandgauge.operators.catalog import extract_links
    page = '<!-- <a href="old.csv">gone</a> --><a href="a&#38;b.csv?x=&#x31;">May&#160;Sessions &#128640; &amp;lt;</a>'
    got = extract_links(spark.createDataFrame([(1, page)], "page_id int, html string")).collect()
    assert [(r.href, r.text) for r in got] == [("a&b.csv?x=1", "may sessions \U0001F680 &lt;")]


def test_references_as_the_standard_library_reads_them(spark):
    import html
    import random
    from demandgauge.operators.catalog import _unescape
    rnd = random.Random(8)
    bits = ["&", "#", ";", "x", "38", "lt", "amp", "eacute", "notin", "copy", "nbsp", "NotEqualTilde", "&#x1F680;", "&#150;", "&#0;", "&#99999999999;", "&amp;", " ", "=", "z", "é"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 9))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", _unescape(F.col("t")).alias("u")).collect()
    known = [(r.t, r.u, html.unescape(r.t).replace("\u00a0", " ")) for r in got]
    assert [x for x in known if x[1] != x[2]] == []
