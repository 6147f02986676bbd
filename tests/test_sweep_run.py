"""Incremental sweep: any split into runs gives what one run gives; untouched slices are not computed."""

import random

from pyspark.sql import functions as F

from demandgauge.operators import sweep
from demandgauge.plans.sweep_run import add_sessions, stored_levels

DAY = 86400
BASE = 1_700_000_000


def made(spark, n, seed, points=("hot",) * 3 + ("a", "b")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.choice([BASE + rng.randrange(400 * DAY), rng.randrange(-90 * DAY, 90 * DAY), BASE + 28 * DAY])
        rows.append((i, rng.choice(points), start, start + rng.choice([0, 1, 60, rng.randrange(3 * DAY), rng.randrange(100 * DAY)])))
    rows.append((n, "a", None, BASE))
    return spark.createDataFrame(rows, "i int, cp_id string, s long, e long").select(
        "i", "cp_id", F.timestamp_seconds("s").alias("start_time"), F.timestamp_seconds("e").alias("end_time"))


def levels(df):
    return {(r.cp_id, r.running): r.seconds for r in df.collect() if r.running > 0 and r.seconds}


def test_runs_add_up_to_one(spark, tmp_path):
    df = made(spark, 120, 1)
    want = levels(sweep.seconds_by_level(df.where("start_time IS NOT NULL AND start_time >= timestamp '1971-01-01'")))
    parts = df.where("start_time IS NULL OR start_time >= timestamp '1971-01-01'")
    path = str(tmp_path / "levels")
    for run in range(3):
        add_sessions(spark, parts.where(F.col("i") % 3 == run), path, run)
    assert levels(stored_levels(spark, path, 3)) == want
    add_sessions(spark, parts.where("i % 3 = 2"), path, 2)  # repeated
    assert levels(stored_levels(spark, path, 3)) == want
    add_sessions(spark, parts.where("false"), path, 3)
    assert levels(stored_levels(spark, path, 4)) == want


def test_times_before_1970(spark, tmp_path):
    df, path = made(spark, 60, 2), str(tmp_path / "levels")
    seconds = {}
    for r in df.where("end_time > start_time").select("cp_id", F.unix_seconds("start_time").alias("s"), F.unix_seconds("end_time").alias("e")).collect():
        seconds.setdefault(r.cp_id, []).extend([(r.s, 1), (r.e, -1)])
    want = {}
    for cp, steps in seconds.items():
        running, last = 0, None
        for t, d in sorted(steps):
            if running and t > last:
                want[cp, running] = want.get((cp, running), 0) + t - last
            running, last = running + d, t
    add_sessions(spark, df.where("i % 2 = 0"), path, 0)
    add_sessions(spark, df.where("i % 2 = 1"), path, 1)
    assert levels(stored_levels(spark, path, 2)) == want


def test_only_touched_slices_are_stored_again(spark, tmp_path):
    df, path = made(spark, 200, 3), str(tmp_path / "levels")
    add_sessions(spark, df, path, 0)
    late = spark.sql("SELECT 'hot' AS cp_id, timestamp '2024-06-01 10:00:00' AS start_time, timestamp '2024-06-01 11:00:00' AS end_time")
    add_sessions(spark, late, path, 1)
    again = spark.read.parquet(f"{path}/levels/run=1")
    assert again.select("cp_id", "slice").distinct().count() == 1
    assert again.agg(F.sum(F.col("running") * F.col("seconds"))).head()[0] == 3600


def test_difference_is_one_pass(spark):
    """Levels without and with new sessions are summed side by side: one shuffle of the changes, and the right difference."""
    from demandgauge.plans import sweep_run

    changes = spark.createDataFrame(
        [("a", 0, 10, 1, 1), ("a", 0, 40, -1, -1), ("a", 0, 20, 0, 1), ("a", 0, 30, 0, -1), ("a", 0, 10, 0, 1), ("a", 0, 15, 0, -1)],
        "cp_id string, slice bigint, second bigint, old bigint, change bigint")
    carried = spark.createDataFrame([("a", 0, 0, 0), ("b", 1, 1, 2)], "cp_id string, slice bigint, old bigint, carried bigint")
    found = sweep_run._difference(changes, carried)
    width = sweep_run.SLICE_SECONDS
    assert sorted(map(tuple, found.collect())) == [("a", 0, 1, -15), ("a", 0, 2, 15), ("b", 1, 1, -width), ("b", 1, 2, width)]
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # as planned and as run
