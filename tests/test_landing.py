import io
import zipfile

from pyspark.sql import functions as F

from demandgauge.plans.clean_run import run_clean
from demandgauge.sources import ledger, landing, tables
from demandgauge.streaming.incremental import clean_stream

GOOD = "CP ID,Connector,Start,Consum(kWh),Duration,Site,Amount\n"


def workbook(rows, styles=None):
    """A minimal workbook with inline strings and numbers; (value, style) gives a styled number."""
    def cell(v):
        if v is None:
            return "<c/>"
        if isinstance(v, tuple):
            return f'<c s="{v[1]}"><v>{v[0]}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f"<worksheet {ns}><sheetData>" + "".join(
        "<row>" + "".join(cell(v) for v in r) + "</row>" for r in rows) + "</sheetData></worksheet>"
    style = f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="46"/></cellXfs></styleSheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/styles.xml", style)
    return out.getvalue()


def fill(folder):
    (folder / "a one+50%.csv").write_text(
        GOOD + "0521,1,25/04/2024 10:00:00,10.5,01:30:00,st john's road,2.5\n"
        "0521,1,25/04/2024 10:00:00,10.5,02:00:00,copy,9\n"
        ",1,25/04/2024 10:00:00,10.5,01:30:00,no id,1\n")
    (folder / "b.csv").write_bytes(
        "start time,connector id,cpid,consumed,,sites,te_charge_type\n"
        "03/04/2024 08:15,2,77,20,3600,Caf\xe9 \"x\",rapid dc\n"
        "2024-03-04 09:00:00,2,78,301,3600,Too much,foo bar\n".encode("latin-1"))
    (folder / "bad.csv").write_text("cp id,start\n1,2\n")
    (folder / "c.XLSX").write_bytes(workbook([
        ["CP ID", "Connector", "Start", "Consum", "Duration", "End_Time"],
        ["900", 1, (45407.5, 1), 12.25, (0.0625, 2), (45407.75, 1)],
        ["901", 1, (45407.5, 1), 12.25, (0.0625, 2), None],
    ]))
    (folder / "broken.xlsx").write_bytes(b"not a zip")
    (folder / "readme.txt").write_text("ignored")


def test_listing_and_checks(spark, tmp_path):
    fill(tmp_path)
    (tmp_path / "empty.csv").write_text("")
    names = {r.file_name for r in landing.list_landing(spark, str(tmp_path)).collect()}
    assert names == {"a one+50%.csv", "b.csv", "bad.csv", "c.XLSX", "broken.xlsx", "empty.csv"}
    checked = {r.filename: (r.error, r.warning) for r in landing.validate_files(
        landing.file_manifest(spark, str(tmp_path))).collect()}
    assert checked["empty.csv"] == ("file is empty", None)
    assert checked["broken.xlsx"][0] == "not a workbook: invalid magic bytes"
    assert checked["c.XLSX"] == (None, "file is unusually small")


def test_clean_run(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    fill(folder)
    report = run_clean(spark, str(folder), table)
    assert report.files == 5
    bad = {r.file: r.reason for r in report.quarantined.collect()}
    assert set(bad) == {"bad.csv", "broken.xlsx"}
    assert "connector" in bad["bad.csv"]
    rows = {r.cp_id: r for r in tables.scan(spark, table).collect()}
    assert set(rows) == {"0521", "77", "900"}
    assert rows["0521"].site_name == "St John'S Road" and rows["0521"].duration_minutes == 90
    assert rows["0521"].source_file == "a one+50%.csv"
    assert rows["77"].site_name == 'Café "X"' and rows["77"].connector_type == "Rapid DC"
    assert str(rows["77"].start_time) == "2024-04-03 08:15:00"
    assert str(rows["77"].end_time) == "2024-04-03 09:15:00"
    assert rows["900"].duration_minutes == 90 and str(rows["900"].end_time) == "2024-04-25 18:00:00"
    m = report.measures
    assert m["read"]["rows"] == 7 and m["deduplicated"]["rows"] == 6
    assert m["identified"]["rows"] == 5 and m["written"]["rows"] == 3
    assert m["written"]["months"] == ["2024-04"]
    # Only files without stored rows are read again.
    again = run_clean(spark, str(folder), table)
    assert again.files == 2 and again.rows_written == 0
    full = run_clean(spark, str(folder), table, full_refresh=True)
    assert full.files == 5 and tables.scan(spark, table).count() == 3
    pruned = tables.scan(spark, table, months=["2024-04"])
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "year_month" in plan[plan.index("PartitionFilters: ["):].split("]")[0]


def test_stream_equals_batch(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    fill(folder)
    state = str(tmp_path / "state")
    clean_stream(spark, str(folder), table, state).awaitTermination()
    got = spark.read.parquet(table)
    assert {r.cp_id for r in got.collect()} == {"0521", "77", "900"}
    (folder / "d.csv").write_text(GOOD + "5,1,01/05/2024 10:00:00,1,01:30:00,x,1\n")
    clean_stream(spark, str(folder), table, state).awaitTermination()
    assert spark.read.parquet(table).count() == 4
    clean_stream(spark, str(folder), table, state).awaitTermination()
    assert spark.read.parquet(table).count() == 4


def test_batch_stream_batch_over_one_table(spark, tmp_path):
    folder, table, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    fill(folder)
    run_clean(spark, str(folder), table)
    (folder / "d.csv").write_text(GOOD + "5,1,01/05/2024 10:00:00,1,01:30:00,x,1\n")
    clean_stream(spark, str(folder), table, state).awaitTermination()
    (folder / "e.csv").write_text(GOOD + "6,1,01/06/2024 10:00:00,1,01:30:00,x,1\n")
    run_clean(spark, str(folder), table)
    got = sorted((r.cp_id, r.source_file) for r in tables.scan(spark, table).collect())
    assert got == [("0521", "a one+50%.csv"), ("5", "d.csv"), ("6", "e.csv"), ("77", "b.csv"), ("900", "c.XLSX")]
    aside = {r.file for r in spark.read.parquet(table + "_quarantined").collect()}
    assert aside == {"bad.csv", "broken.xlsx"}


def test_damaged_workbook_is_set_aside_whole(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    head = ["CP ID", "Connector", "Start", "Consum", "Duration"]
    rows = [head] + [[f"c{i}", 1, (45407.5, 1), 12.25, (0.0625, 2)] for i in range(6000)]
    whole = zipfile.ZipFile(io.BytesIO(workbook(rows)))
    cut = io.BytesIO()
    with zipfile.ZipFile(cut, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", whole.read("xl/worksheets/sheet1.xml")[:-200])
        z.writestr("xl/styles.xml", whole.read("xl/styles.xml"))
    (folder / "cut.xlsx").write_bytes(cut.getvalue())
    (folder / "good.xlsx").write_bytes(workbook(rows[:3]))
    report = run_clean(spark, str(folder), table)
    assert [r.file for r in report.quarantined.collect()] == ["cut.xlsx"]
    assert {r.source_file for r in tables.scan(spark, table).collect()} == {"good.xlsx"}


def test_first_sheet_is_the_one_listed_first(spark):
    from demandgauge.sources.xlsx import sheet_rows
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook([["second"]]))) as a, zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", a.read("xl/worksheets/sheet1.xml"))
        z.writestr("xl/worksheets/sheet2.xml", a.read("xl/worksheets/sheet1.xml").replace(b"second", b"first"))
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="x" r:id="rId7"/><sheet name="y" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
                   '<Relationship Id="rId7" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
    assert list(sheet_rows(out.getvalue())) == [["first"]]


def test_unknown_headers_do_not_add_scans(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.csv").write_text(f"CP ID,Connector,Start,Consum,Duration,note {i}\n{i},1,01/05/2024 10:00:00,1,01:30:00,x\n")
    plan = landing.plan_headers(landing.csv_headers(spark, [str(tmp_path)]))
    raw = landing.read_session_csv(spark, plan)
    assert raw._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    assert raw.count() == 40


def test_quoted_line_breaks(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.csv").write_text('CP ID,Site,Connector,Start,Consum,Duration\n7,"North\nside",1,01/05/2024 10:00:00,1,01:30:00\n')
    run_clean(spark, str(folder), table, multi_line=True)
    assert [(r.cp_id, r.site_name) for r in tables.scan(spark, table).collect()] == [("7", "North\nSide")]


def test_header_plan(spark):
    files = spark.createDataFrame([
        (1, ["CP ID", "connector", "start", "consum", ""]),
        (2, ["cp id", "connector", "start", "consum", "", ""]),
        (3, ["cp id", "connector", "start", "consum", "duration", ""]),
        (4, ["cp id", "cpid", "connector", "start", "consum", "duration"]),
        (5, ["cp id", "cp id", "connector", "start", "consum", "duration_time", ""]),
        (6, [" CONNECTO ID ", "display id", "Unnamed: 3", "StartTime", "Consumed", "End Time"]),
    ], "id int, headers array<string>")
    got = {r.id: r for r in landing.plan_headers(files).collect()}
    assert got[1].columns[-1] == "duration" and got[1].reason is None
    assert got[2].reason == "missing required columns: duration"
    assert got[3].columns[-1] == "unnamed: 5" and got[3].reason is None
    assert got[4].reason == "two headers for one column"
    assert got[5].reason is None and got[5].columns[1] == "cp id.1"
    assert got[6].columns == ["connector", "cp_id", "duration", "start_time", "consumption_kwh", "end time"]
    assert got[6].reason is None


def test_seed_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "areas")
    seed = tables.postcode_areas(spark)
    tables.merge_insert_missing(spark, seed.limit(3), path, "area_code")
    tables.merge_insert_missing(spark, seed, path, "area_code")
    tables.merge_insert_missing(spark, seed, path, "area_code")
    assert spark.read.parquet(path).count() == 16
    assert spark.read.parquet(path).agg(F.count_distinct("area_code")).first()[0] == 16


def states(spark, table):
    return {r.file_name: (r.state, r.reason) for r in ledger.latest(spark.read.parquet(ledger.ledger_path(table))).collect()}


def test_ledger_knows_every_file(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    fill(folder)
    (folder / "none.csv").write_text(GOOD + "nan,1,01/05/2024 10:00:00,1,01:30:00,x,1\n")
    (folder / "zero + 1.csv").write_text("")
    run_clean(spark, str(folder), table)
    found = states(spark, table)
    assert {n for n, (s, _) in found.items() if s == "stored"} == {"a one+50%.csv", "b.csv", "c.XLSX"}
    assert found["none.csv"] == ("empty", None) and found["zero + 1.csv"] == ("unusable", "file is empty")
    assert found["bad.csv"][1].startswith("missing required columns: ") and found["broken.xlsx"][0] == "unusable"
    # A file that is mended under its name is read again, one that is gone from the landing stays noted.
    (folder / "none.csv").write_text(GOOD + "8,1,01/05/2024 10:00:00,1,01:30:00,x,1\n")
    (folder / "b.csv").unlink()
    run_clean(spark, str(folder), table)
    assert states(spark, table)["none.csv"] == ("stored", None) and states(spark, table)["b.csv"] == ("stored", None)
    assert tables.scan(spark, table).count() == 4
    # A full refresh holds only what it found.
    run_clean(spark, str(folder), table, full_refresh=True)
    assert "b.csv" not in states(spark, table) and tables.scan(spark, table).count() == 3


def test_run_that_died_between_its_notes(spark, tmp_path):
    """Files noted as started are looked up in the table: the stored one is left out, the other is read."""
    folder, table = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.csv").write_text(GOOD + "5,1,01/05/2024 10:00:00,1,01:30:00,x,1\n")
    run_clean(spark, str(folder), table)
    (folder / "b.csv").write_text(GOOD + "6,1,01/05/2024 10:00:00,1,01:30:00,x,1\n")
    started = spark.createDataFrame([("a.csv",), ("b.csv",)], "file_name string")
    ledger.note(started, table, ledger.Run(), ledger.STARTED)
    assert {r.file_name for r in ledger.stored_files(spark, table).collect()} == {"a.csv"}
    assert run_clean(spark, str(folder), table).files == 1
    assert tables.scan(spark, table).count() == 2
    assert run_clean(spark, str(folder), table).files == 0


def test_table_from_before_the_ledger(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.csv").write_text(GOOD + "5,1,01/05/2024 10:00:00,1,01:30:00,x,1\n")
    run_clean(spark, str(folder), str(tmp_path / "first"))
    tables.write_sessions(tables.scan(spark, str(tmp_path / "first")), table)
    assert run_clean(spark, str(folder), table).files == 0 and states(spark, table) == {"a.csv": ("stored", None)}


def test_many_small_files_cost_no_call_each(spark, tmp_path, monkeypatch):
    """Listing 1,500 files takes as many calls into the JVM as listing 15, empty files aside."""
    calls = []
    client = spark.sparkContext._gateway._gateway_client
    send = type(client).send_command
    monkeypatch.setattr(type(client), "send_command", lambda self, *a, **k: calls.append(1) or send(self, *a, **k))
    counts = []
    for size in (15, 1500):
        folder = tmp_path / f"in{size}"
        folder.mkdir()
        for i in range(size):
            (folder / f"{i}.csv").write_text("x")
        (folder / "zero.csv").write_text("")
        calls.clear()
        listed = landing.list_landing(spark, str(folder))
        counts.append(len(calls))
        assert listed.count() == size + 1 and listed.where("length = 0").count() == 1
    assert counts[1] <= counts[0] + 20
