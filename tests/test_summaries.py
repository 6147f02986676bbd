"""Subtotals, stored sketches, range frames, previous rows and row numbers on hand-made and random rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from demandgauge.operators import frames as R, summaries as S

START = dt.datetime(2024, 1, 1)
SCHEMA = "i int, k string, start_time timestamp, duration_minutes double, consumption_kwh double"


def made(spark, seed=1, n=400, keys=("hot",) * 4 + ("a", None)):
    rng = random.Random(seed)
    rows = [(i, rng.choice(keys), rng.choice([START + dt.timedelta(minutes=rng.randrange(-90000, 90000))] * 12 + [None]),
             rng.choice([None, float(rng.randrange(50))]), float(rng.randrange(9))) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_subtotals_expand_the_pre_aggregate(spark):
    rows, df = made(spark)
    found = S.usage_subtotals(df, [["k"], [], ["k"]])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Expand") == 1 and plan.index("Expand") < plan.rindex("HashAggregate")
    got = sorted(((r.k, r.level, r.sessions, r.energy_kwh, r.mean_minutes) for r in found.collect()), key=str)

    def total(k, level, own):
        timed = [r[3] for r in own if r[3] is not None]
        return (k, level, len(own), sum(r[4] for r in own), sum(timed) / len(timed))

    per_key = [total(k, 0, [r for r in rows if r[1] == k]) for k in ("hot", "a", None)]
    assert got == sorted([*per_key, *per_key, total(None, 1, rows)], key=str)
    assert S.usage_subtotals(df.where("false"), S.rollup_sets(["k"])).collect() == []
    assert S.cube_sets(["a", "b"]) == [["a", "b"], ["b"], ["a"], []]


def test_sketches_merge_over_months_and_appends(spark, tmp_path):
    n = 60_000
    df = spark.range(n).select(
        F.lit("p").alias("cp_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 400).alias("start_time"),
        (F.col("id") * 7919 % n).cast("double").alias("duration_minutes"), (F.col("id") % 21_000).alias("user"))
    for part in (df.where("id % 2 = 0"), df.where("id % 2 = 1")):  # two appends of the same months
        S.monthly_sketches(part, ["cp_id"], F.col("user")).write.mode("append").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    months = stored.select("year_month").distinct().count()
    assert stored.count() == 2 * months > 10
    whole = S.merged_use(stored, ["cp_id"], [0.1, 0.5, 0.99]).head()
    assert whole.sessions == n and abs(whole.users - 21_000) <= S.DISTINCT_ERROR * 21_000
    for value, q in ((whole.q10, 0.1), (whole.q50, 0.5), (whole.q99, 0.99)):
        assert abs(value / n - q) <= S.RANK_ERROR
    some = S.merged_use(stored.where("year_month IN ('2024-02', '2024-05')"), [], [0.5]).head()
    exact = df.where("date_format(start_time, 'yyyy-MM') IN ('2024-02', '2024-05')")
    assert some.sessions == exact.count() and abs(some.users - exact.select("user").distinct().count()) <= S.DISTINCT_ERROR * some.users
    none = S.merged_use(S.monthly_sketches(df.limit(3).withColumns({"duration_minutes": F.lit(None).cast("double"), "user": F.lit(None).cast("long")}),
                                           ["cp_id"], F.col("user")), ["cp_id"], [0.5]).head()
    assert (none.sessions, none.users, none.q50) == (3, 0, None)


@pytest.mark.parametrize(("back", "slices"), [(3600, 3600), (86400, 90000), (7 * 86400, None)])
def test_rolling_equals_sql_frame(spark, back, slices):
    _, df = made(spark)
    got = R.rolling(df, ["k"], "start_time", back, {"n": F.count(F.lit(1)), "kwh": F.sum("consumption_kwh")}, slices)
    df.createOrReplaceTempView("rolling_rows")
    want = spark.sql(f"""SELECT *, count(*) OVER w AS n, sum(consumption_kwh) OVER w AS kwh FROM rolling_rows
        WINDOW w AS (PARTITION BY k ORDER BY start_time RANGE BETWEEN INTERVAL {back} SECONDS PRECEDING AND CURRENT ROW)""")
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    with pytest.raises(ValueError, match="at least as long"):
        R.rolling(df, ["k"], "start_time", 10, {}, 5)


@pytest.mark.parametrize("slices", [3600, 86400 * 365])
def test_previous_row_across_empty_slices(spark, slices):
    rows, df = made(spark, seed=3)
    got = {r.i: (r.before, r.kwh_before) for r in R.with_previous(
        df, ["k"], ["start_time", "i"], {"i": "before", "consumption_kwh": "kwh_before"}, slices).collect()}
    want = {r[0]: (None, None) for r in rows}
    for k in ("hot", "a"):
        own = sorted((r[2], r[0], r[4]) for r in rows if r[1] == k and r[2] is not None)
        want |= {b[1]: (a[1], a[2]) for a, b in zip(own, own[1:], strict=False)}
    assert got == want


def test_row_numbers_and_tiles(spark):
    rows, df = made(spark, seed=4, n=103)
    found = R.with_row_number(df, ["duration_minutes", "i"], "place", "n").select("*", R.ntile("place", "n", 10).alias("tile")).collect()
    order = [r[0] for r in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, r[0]))]
    assert [r.i for r in sorted(found, key=lambda r: r.place)] == order and {r.n for r in found} == {103}
    assert [r.tile for r in sorted(found, key=lambda r: r.place)] == [t for t in range(1, 11) for _ in range(11 if t <= 3 else 10)]
    few = R.with_row_number(df.where("i < 3"), ["i"], "place", "n").select(R.ntile("place", "n", 5).alias("t")).collect()
    assert sorted(r.t for r in few) == [1, 2, 3]
    assert R.with_row_number(df.where("false"), ["i"]).collect() == []
