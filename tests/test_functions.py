import random

import pytest
from pyspark.sql import functions as F

from demandgauge.functions import numbers as N, periods as Pd, text as X, times as Tm


def each(spark, values, expr, kind="string"):
    """Results of a column expression on single values, in input order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_timestamps(spark):
    cases = {
        "25/04/2024 10:11:12": "2024-04-25 10:11:12", "03/04/2024": "2024-04-03 00:00:00",
        "3/4/2024 7:05": "2024-04-03 07:05:00", "25-04-2024 00:00:01": "2024-04-25 00:00:01",
        "25/04/24 10:00": "2024-04-25 10:00:00", "2024-03-04": "2024-03-04 00:00:00",
        "2024-03-25T01:02:03": "2024-03-25 01:02:03", "\t01/02/2023 00:00:00 ": "2023-02-01 00:00:00",
        "garbage": None, "31/02/2024": None, "04/25/2024": None, "12:30": None, "2024": None, None: None,
    }
    got = each(spark, list(cases), Tm.parse_uk_timestamp)
    assert [None if g is None else str(g) for g in got] == list(cases.values())


def test_durations(spark):
    cases = {"01:30:00": 90, "25:10:00": 1510, "1 days 02:00:00": 1560, "3600": 60, "90.0": 1.5, "01:30": None,
             "": None, "nan": None, None: None, "00:00:30.5": 30.5 / 60}
    assert each(spark, list(cases), Tm.duration_minutes) == list(cases.values())


def test_planned_end_drops_the_fraction_of_the_start(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00.75' s, cast(null as timestamp) e, 1.5D m")
    got = df.select(Tm.end_or_planned(F.col("s"), F.col("e"), F.col("m")).alias("x"),
                    Tm.add_minutes(F.col("s"), F.col("m")).alias("y")).first()
    assert str(got.x) == "2024-01-01 00:01:30" and str(got.y) == "2024-01-01 00:01:30.750000"


def test_title_case_equals_python(spark):
    letters = "abXYZ éÉßñ 019'-./()\tø"
    rng = random.Random(7)
    words = ["st john's road", "a-b 2nd st", "McDONALD's", ""] + [
        "".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    assert each(spark, words, X.title_case) == [w.title() for w in words]
    assert each(spark, [None, "  st john's "], X.site_title) == [None, "St John'S"]


def test_ids_and_types(spark):
    ids = ["nan", "NA", "None", "", None, "0521", "x"]
    assert each(spark, ids, X.is_missing_id) == [True, True, True, True, True, False, False]
    assert each(spark, ["\t0521 \xa0", " a b "], X.clean_id) == ["0521", "a b"]
    assert each(spark, ["ac", " RAPID dc ", "chademo x", None], X.connector_type) == ["AC", "Rapid DC", "Chademo X", None]
    assert each(spark, ["AC_2_PHASE", "DC", "CCS", None], X.power_type) == ["AC", "DC", "CCS", None]
    assert each(spark, [" eh1 2ab", "G12", "M11", "12", "", None], X.postcode_area) == ["EH", "G", "M", None, None, None]


def test_numbers(spark):
    assert each(spark, ["1.5", "nan", "x", " 2 ", None], N.to_double) == [1.5, None, None, 2.0, None]
    df = spark.sql("SELECT * FROM VALUES (1, 2D, 4D), (2, 2D, 0D), (3, 8D, 4D), (4, cast(null as double), 4D) v(i, n, d)")
    got = df.select("i", N.capped(N.ratio_or_null(F.col("n"), F.col("d"))).alias("a"),
                    N.ratio_or_zero(F.col("n"), F.col("d")).alias("b")).orderBy("i").collect()
    assert [(r.a, r.b) for r in got] == [(0.5, 0.5), (None, 0.0), (1.0, 2.0), (None, 0.0)]


def test_file_name_periods(spark):
    names = ["MAY-26-SESSIONS.xlsx", "Sessions-JAN-24.xlsx", "OCT-SESSIONS-NEW.xlsx", "June_2024.csv",
             "sept-2023x.csv", "MAR-123.csv", "x.csv"]
    got = each(spark, names, Pd.filename_period)
    assert [None if g is None else tuple(g) for g in got] == [
        (2026, 5), (2024, 1), None, (2024, 6), (2023, 9), (123, 3), None]


@pytest.mark.parametrize("name,month", [
    ("NOV-SESSIONS.xlsx", 11), ("june-sessions.csv", 6), ("DEC and jan", 1), ("data", None), ("SUMMARY", 3)])
def test_month_in_name(spark, name, month):
    assert each(spark, [name], Pd.month_in_name) == [month]


def test_json_object_text(spark):
    texts = ['a {"x": {"y": 1}} b', "none", "} {", '{"a": 1} and {"b": 2}', None]
    assert each(spark, texts, X.json_object_text) == [
        '{"x": {"y": 1}}', None, None, '{"a": 1} and {"b": 2}', None]


def test_forms_of_dates_and_numbers(spark):
    from demandgauge.functions.numbers import to_double
    from demandgauge.functions.times import duration_minutes, parse_uk_timestamp
    dates = {"25/04/2024 2:05 PM": "2024-04-25 14:05:00", "25/04/2024 12:05:09 am": "2024-04-25 00:05:09", "3 March 2024 09:15": "2024-03-03 09:15:00",
             "03-Mar-2024": "2024-03-03 00:00:00", "2024/03/04": "2024-03-04 00:00:00", "2024/3/4 07:00:00": "2024-03-04 07:00:00", "31 Foo 2024": None, "12d": None}
    df = spark.createDataFrame([(k,) for k in dates], "t string")
    got = {r.t: r.ts for r in df.select("t", parse_uk_timestamp(df.t).alias("ts")).collect()}
    assert {k: v and str(v) for k, v in got.items()} == dates
    numbers = {"12d": None, "7f": None, " 1.5 ": 1.5, "-.5e2": -50.0, "1,5": None, "0x1F": None, "": None, "NaN": None, "3.": 3.0}
    df = spark.createDataFrame([(k,) for k in numbers], "t string")
    assert {r.t: r.n for r in df.select("t", to_double(df.t).alias("n")).collect()} == numbers
    seconds = {"90f": None, "Infinity": None, "-inf": None, "90": 1.5, "01:30:00": 90.0}
    df = spark.createDataFrame([(k,) for k in seconds], "t string")
    assert {r.t: r.m for r in df.select("t", duration_minutes(df.t).alias("m")).collect()} == seconds


def test_dates_in_unusual_order(spark):
    cases = {"March 4, 2024 10:00": "2024-03-04 10:00:00", "mar 4 2024": "2024-03-04 00:00:00", "20240304 10:00": "2024-03-04 10:00:00",
             "20240304": "2024-03-04 00:00:00", "Monday, 04/03/2024 09:15": "2024-03-04 09:15:00", "Mon 4 March 2024 09:15:30": "2024-03-04 09:15:30",
             "Tue, March 5th, 2024 7:05": "2024-03-05 07:05:00", "03/04/2024": "2024-04-03 00:00:00", "2024-03-04": "2024-03-04 00:00:00",
             "Monday": None, "March 2024x": None, "20241304": None}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", Tm.parse_uk_timestamp(F.col("s")).cast("string").alias("t"))
    assert {r.s: r.t for r in rows.collect()} == cases


def test_sheets_are_read_without_a_tree(monkeypatch):
    """Rows come from the parser's own events, for all kinds of cells; a tree of every element took half of the time."""
    import io
    import zipfile
    from xml.etree import ElementTree

    from demandgauge.sources import xlsx

    def no_tree(*_, **__):
        raise AssertionError("a tree of the sheet")

    monkeypatch.setattr(ElementTree, "iterparse", no_tree)
    sheet = ('<x:worksheet xmlns:x="urn:m"><x:sheetData><x:row><x:c t="inlineStr"><x:is><x:r><x:t>a &amp; </x:t></x:r><x:r><x:t>b</x:t></x:r></x:is></x:c>'
             '<x:c r="D1"><x:f>1+1</x:f><x:v>2</x:v><x:v>3</x:v></x:c><x:c t="b"><x:v>1</x:v></x:c><x:c t="e"><x:v>#N/A</x:v></x:c><x:c><x:v/></x:c></x:row>'
             '<x:row/></x:sheetData></x:worksheet>')
    for text, error in ((sheet, None), (sheet[:-30], ElementTree.ParseError)):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as book:
            book.writestr("xl/worksheets/sheet1.xml", text)
        rows = xlsx.sheet_rows(out.getvalue())
        if error:
            with pytest.raises(error):
                list(rows)
        else:
            assert list(rows) == [["a & b", None, None, "2", "True", None, None], []]
