import datetime

from pyspark.sql import functions as F

from demandgauge import constants as K, schemas
from demandgauge.operators.metrics import RunMetrics
from demandgauge.operators import pressure as P, profiles as V, sites as S
from demandgauge.plans.gold_run import run_pressure, stored_site_view, unplaced_sessions
from demandgauge.sources import tables


def make_sessions(spark, n=400):
    i = F.col("id")
    start = F.timestamp_seconds(F.lit(1704067200) + i * 1800)
    return spark.range(n).select(
        F.concat(F.lit("cp"), (i % 5).cast("string")).alias("cp_id"), (i % 2).cast("string").alias("connector"),
        start.alias("start_time"), F.timestamp_seconds(F.unix_seconds(start) + (i % 7 + 1) * 1200).alias("end_time"),
        ((i % 7 + 1) * 20).cast("double").alias("duration_minutes"), F.lit(5.0).alias("consumption_kwh"),
        F.when(i % 3 != 0, 1.0).alias("amount"), F.date_format(start, "yyyy-MM").alias("year_month"))


def make_connectors(spark):
    return spark.sql("""
      SELECT * FROM VALUES
        ('cp0', '2', 2, 'Alpha', 'EH1 1AA', 56D, -3D), ('cp0', '1', 2, null, 'EH1 1AA', 56D, -3D),
        ('cp1', '1', 1, 'Beta', 'EH1 1AA', 56D, -3D), ('cp2', '1', 1, 'Gamma', 'G1 1AA', 55D, -4D),
        ('cp3', '1', 1, 'Delta', '', null, null)
      v(cp_id, connector_id, n_connectors, site_name, postcode, latitude, longitude)""")


def test_run_pressure(spark, tmp_path):
    s, c, g = (str(tmp_path / x) for x in ("s", "c", "g"))
    tables.write_sessions(make_sessions(spark), s)
    tables.write_table(make_connectors(spark), c)
    now = F.lit("2026-01-01").cast("timestamp")
    metrics = RunMetrics()
    gold = run_pressure(spark, s, c, g, min_sessions=80, now=now, metrics=metrics)
    assert {k: v["rows"] for k, v in metrics.report().items()} == {"measured": 4, "rankable": 3}
    assert [f.name for f in gold.schema.fields] == [f.name for f in schemas.PRESSURE.fields]
    assert [f.dataType for f in gold.schema.fields] == [f.dataType for f in schemas.PRESSURE.fields]
    rows = {r.cp_id: r for r in gold.collect()}
    assert set(rows) == {"cp0", "cp1", "cp2"}  # cp3 has no coordinates, cp4 no location
    assert rows["cp0"].site_name == "Alpha" and rows["cp0"].total_sessions == 80
    assert rows["cp1"].single_connector and not rows["cp0"].single_connector
    assert sorted(r.pressure_rank for r in rows.values())[0] == 1
    assert {r.cp_id for r in unplaced_sessions(tables.scan(spark, s), tables.scan(spark, c)).collect()} == {"cp4"}
    view = {r.site_key: r for r in stored_site_view(spark, g).collect()}
    assert set(view) == {"56.0,-3.0", "55.0,-4.0"}
    both = view["56.0,-3.0"]
    assert both.n_charge_points == 2 and both.n_connectors == 3 and both.site_name == "Alpha"
    assert abs(both.total_energy_kwh - 800) < 1e-9
    assert abs(both.saturated_hours - rows["cp0"].saturated_hours - rows["cp1"].saturated_hours) < 1e-9
    members = S.site_members(gold).where("site_key = '56.0,-3.0'")
    assert {r.cp_id for r in members.collect()} == {"cp0", "cp1"}
    assert run_pressure(spark, s, c, str(tmp_path / "none"), min_sessions=81).count() == 0


def test_zero_denominators(spark):
    df = spark.sql("SELECT 1D occupied_hours, 0D available_connector_hours, 1D saturated_hours, 0D cp_available_hours")
    point = df.select(P.utilisation().alias("u"), P.saturation_rate().alias("s")).first()
    assert point.u is None and point.s is None
    site = S.site_rates(df).first()
    assert site.utilisation == 0 and site.saturation_rate == 0


def test_region_queries(spark):
    sites = spark.sql("""SELECT * FROM VALUES ('a', 'EH', 1D, 1D, 2), ('b', 'EH', 3D, 3D, 1), ('c', null, 1D, 1D, 3),
                         ('d', 'XX', null, 1D, 4) v(site_key, postcode_area, latitude, longitude, pressure_rank)""")
    assert [r.site_key for r in S.region_sites(sites, "EH").collect()] == ["b", "a"]
    assert [r.postcode_area for r in S.distinct_areas(sites).collect()] == ["EH", "XX"]
    named = {r.site_key: r.area_name for r in S.with_area_name(sites).collect()}
    assert named == {"a": "Edinburgh", "b": "Edinburgh", "c": None, "d": "XX"}
    by_table = {r.site_key: r.area_name for r in S.with_area_name(sites, tables.postcode_areas(spark)).collect()}
    assert by_table == named
    flags = {r.site_key: r.in_region for r in S.highlight(sites, "EH").collect()}
    assert flags == {"a": True, "b": True, "c": False}
    centre = S.region_centre(sites).first()
    assert (centre.latitude, centre.n_sites) == (2.0, 2)


def test_profiles_and_bundle(spark):
    s = make_sessions(spark)
    grid = V.weekday_hour_grid(s)
    assert grid.count() == 168 and grid.agg(F.sum("sessions")).first()[0] == 400
    bands = V.hour_duration_grid(s)
    assert [r.dur_band for r in bands.where("hour = 0").orderBy("row_no").collect()] == K.BAND_ORDER
    assert V.period(s).first().date_min == datetime.date(2024, 1, 1)
    members = spark.createDataFrame([("x", "cp0"), ("x", "cp1"), ("y", "cp2")], "site_key string, cp_id string")
    bundle = V.site_bundle(s, members)
    mine = V.sessions_of(s, members.where("site_key = 'x'"))
    part = bundle.where("site_key = 'x'")
    assert part.where("part = 'trend'").agg(F.sum("n")).first()[0] == mine.count()
    days = {r.day_type: r.n for r in part.where("part = 'daycounts'").collect()}
    assert days == {r.day_type: r.days for r in V.day_counts(mine).collect()}
    prof = {(r.dow, r.hour): r.n for r in part.where("part = 'profile'").collect()}
    assert prof == {(r.dow, r.hour): r.sessions for r in V.weekday_hour(mine).collect()}
    assert V.average_profile(V.weekday_hour(mine), V.day_counts(mine)).where("avg_sessions > 5").count() == 0
