import random
import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from demandgauge.operators import pressure as P, sweep

BASE = 1704067200


def sessions(spark, rows):
    df = spark.createDataFrame(rows, "cp_id string, s long, e long")
    return df.select("cp_id", F.timestamp_seconds(F.col("s") + BASE).alias("start_time"),
                     F.timestamp_seconds(F.col("e") + BASE).alias("end_time"))


def capacity(spark, rows):
    return spark.createDataFrame(rows, "cp_id string, n_connectors int")


def saturated(spark, rows, caps):
    got = sweep.saturated_hours(sessions(spark, rows), capacity(spark, caps)).collect()
    return {r.cp_id: round(r.saturated_hours * 3600) for r in got}


def brute(intervals, k):
    """Seconds with at least k running, by looking at every stretch between two event times."""
    if not k or k <= 0:
        return 0
    times = sorted({t for i in intervals for t in i})
    return sum(b - a for a, b in zip(times, times[1:]) if sum(s <= a < e for s, e in intervals) >= k)


def test_hand_sized_cases(spark):
    rows = [("a", 0, 10), ("a", 5, 15), ("a", 10, 20), ("a", 12, 13)]
    rows += [("b", 0, 10), ("b", 20, 25), ("c", 0, 10), ("d", 0, 10), ("e", 0, 10)]
    got = saturated(spark, rows, [("a", 2), ("b", 1), ("c", None), ("d", 0)])
    assert got == {"a": 10, "b": 15, "c": 0, "d": 0}  # e has no location and drops


def test_long_sessions_cross_slices(spark):
    part = sweep.SLICE_SECONDS
    rows = [("a", 100, 10 * part), ("a", 3 * part + 5, 3 * part + 65), ("a", 9 * part, 12 * part)]
    assert saturated(spark, rows, [("a", 2)]) == {"a": 60 + part}
    assert saturated(spark, rows, [("a", 1)]) == {"a": 12 * part - 100}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10 ** 6))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, caps = [], []
    for cp in "abcdef":
        caps.append((cp, rng.randint(1, 4)))
        for _ in range(rng.randint(1, 40)):
            s = rng.randint(0, 9_000_000)
            rows.append((cp, s, s + rng.choice([0, 1, 60, 90000, 400_000, 3_000_000, 6_000_000])))
    rng.shuffle(rows)
    want = {cp: brute([(s, e) for c, s, e in rows if c == cp], k) for cp, k in caps}
    assert saturated(spark, rows, caps) == want


def test_one_connector_without_overlap_is_occupied_time(spark):
    rows = [("a", i * 1000, i * 1000 + 60 * (i + 1)) for i in range(10)]
    assert saturated(spark, rows, [("a", 1)]) == {"a": sum(60 * (i + 1) for i in range(10))}


def test_plan_is_native_and_shares_the_changes(spark, tmp_path):
    path = str(tmp_path / "s")
    sessions(spark, [("a", 0, 10), ("b", 5, 10)]).write.parquet(path)
    df = sweep.saturated_hours(spark.read.parquet(path), capacity(spark, [("a", 1), ("b", 1)]))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and "Python" not in plan and "Pandas" not in plan
    assert len(re.findall("FileScan", plan)) == 1


def test_windows_and_usage(spark):
    rows = spark.sql("""
      SELECT * FROM VALUES
        ('a', '1', timestamp'2024-01-01 00:00:00.5', timestamp'2024-01-01 01:00:00.9', 60D, 5D, 1D),
        ('a', '1', timestamp'2024-01-01 02:00:00', cast(null as timestamp), 90D, 5D, null),
        ('a', '2', timestamp'2024-01-01 04:00:00', timestamp'2024-01-01 04:00:00', 0D, 1D, 2D)
      v(cp_id, connector, start_time, end_time, duration_minutes, consumption_kwh, amount)""")
    windows = P.connector_windows(P.with_end_filled(rows))
    got = {r.connector: r.available_hours for r in windows.collect()}
    assert got == {"1": 3.5, "2": 0.0}
    usage = P.cp_usage(windows).first()
    assert usage.total_sessions == 3 and usage.available_connector_hours == 3.5
    assert usage.total_revenue == 3 and usage.occupied_hours == 2.5
    assert abs(usage.cp_available_hours - (4 - 0.5 / 3600)) < 1e-9
