import json

import pytest
from pyspark.sql import functions as F

from demandgauge import schemas
from demandgauge.operators import connectors as D
from demandgauge.plans.locations_run import run_locations
from demandgauge.sources import locations as L

FEED = [
    {"name": "One", "address": "1 Road", "city": "Town", "postal_code": "EH1 1AA",
     "coordinates": {"latitude": "56.5", "longitude": -3.25},
     "evses": [
         {"id": "52118", "status": "AVAILABLE", "connectors": [{"id": 1, "power_type": "AC_3_PHASE", "max_charge_rate": 22}]},
         {"id": "52118", "status": "CHARGING", "connectors": [
             {"id": "2", "power_type": "DC", "max_charge_rate": None}, {"id": "1", "power_type": "DC"}, {"power_type": "DC"}]},
         {"status": "NO ID", "connectors": [{"id": "1"}]},
         {"id": "7", "connectors": []},
         {"id": "8"},
     ]},
    {"name": "No place", "evses": [{"id": "9", "connectors": [{"id": "1"}]}]},
    {"name": "Bad place", "coordinates": {"latitude": "north", "longitude": "1"}, "evses": []},
    {"name": "Override", "postal_code": "M11 8RP", "coordinates": {"latitude": 1.0, "longitude": 2.0},
     "evses": [{"id": "61203", "connectors": [{"id": "1", "power_type": "CCS"}]},
               {"id": "53143", "connectors": [{"id": "1"}]}]},
]


def snapshot(folder, day, data=FEED):
    body = {"harvested_at": day, "feed_url": "https://example.org", "location_count": len(data), "evse_count": 8,
            "status_code": 200, "data": data}
    (folder / f"Scotland_chargepoint_locations_{day}.json").write_text(json.dumps(body, indent=1))


def test_run_locations(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    snapshot(folder, "2026-01-01", [])
    snapshot(folder, "2026-02-01")
    (folder / "other.json").write_text("{}")
    target = str(tmp_path / "out")
    stored = run_locations(spark, str(folder), target, min_connectors=4, min_locations=4)
    assert [f.name for f in stored.schema.fields] == [f.name for f in schemas.CHARGE_POINTS.fields]
    rows = {(r.cp_id, r.connector_id): r for r in stored.collect()}
    assert set(rows) == {("52118", "1"), ("52118", "2"), ("61203", "1"), ("53143", "1")}
    first = rows["52118", "1"]
    assert (first.n_connectors, first.connector_type, first.max_charge_rate_kw) == (2, "AC", 22.0)
    assert (first.network_status, first.latitude, first.longitude) == ("AVAILABLE", 56.5, -3.25)
    assert (first.postcode_source, first.coord_source) == ("feed", "feed")
    assert (rows["61203", "1"].postcode, rows["61203", "1"].postcode_source) == ("ML11 8RP", "override")
    assert rows["61203", "1"].connector_type == "CCS"
    assert (rows["53143", "1"].latitude, rows["53143", "1"].coord_source) == (55.066793, "override")
    assert first.source_snapshot == "Scotland_chargepoint_locations_2026-02-01.json"


def test_gate_leaves_the_table_alone(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    snapshot(folder, "2026-02-01")
    target = str(tmp_path / "out")
    run_locations(spark, str(folder), target, min_connectors=4, min_locations=4)
    with pytest.raises(ValueError, match="expected at least 1000"):
        run_locations(spark, str(folder), target)
    assert spark.read.parquet(target).count() == 4


def test_counts(spark, tmp_path):
    snapshot(tmp_path, "2026-02-01")
    locs = L.locations(L.read_snapshot(spark, str(tmp_path)))
    counted = L.snapshot_counts(locs).first()
    assert (counted.location_count, counted.evse_count) == (4, 8)
    skipped = D.skip_counts(locs).first()
    assert (skipped.locations, skipped.evses, skipped.connectors, skipped.skipped) == (2, 3, 1, 6)


def test_no_snapshot(spark):
    files = spark.createDataFrame([("/a/x.json", "x.json")], "path string, file_name string")
    with pytest.raises(FileNotFoundError):
        L.latest_snapshot(files)


def test_empty_overrides(spark):
    rows = spark.createDataFrame([("1", "G1", 1.0, 2.0)], "cp_id string, postcode string, latitude double, longitude double")
    got = D.apply_overrides(rows, {}, {}).first()
    assert (got.postcode, got.postcode_source, got.coord_source) == ("G1", "feed", "feed")
    table = spark.createDataFrame([("1", "G2")], "cp_id string, postcode string")
    assert D.apply_overrides(rows, table, {}).first().postcode == "G2"
    assert D.apply_overrides(rows, table, {}).select(F.col("latitude")).first()[0] == 1.0
