"""Interval and as-of joins against plain comparison of all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from demandgauge.operators.asof import asof_join
from demandgauge.operators.intervals import interval_join

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + dt.timedelta(minutes=minutes)


def spans(rng, n, keys, longest):
    out = []
    for i in range(n):
        begin = rng.choice([rng.randrange(-60 * 24 * 400, 60 * 24 * 400), rng.randrange(600)])
        length = rng.choice([0, -5, 1, 60, 61, rng.randrange(1, 300), rng.randrange(1, longest)])
        key = rng.choice(keys)
        out.append((i, key, at(begin if rng.random() > 0.03 else None), at(begin + length if rng.random() > 0.03 else None)))
    return out


@pytest.mark.parametrize(("seed", "keys"), [(1, ["a", "b", None]), (2, ["hot"] * 5 + ["x", "y"])])
def test_interval_join_equals_all_pairs(spark, seed, keys):
    rng = random.Random(seed)
    left, right = spans(rng, 250, keys, 60 * 24 * 300), spans(rng, 200, keys, 60 * 24 * 900)
    got = interval_join(
        spark.createDataFrame(left, "i int, k string, ls timestamp, le timestamp"),
        spark.createDataFrame(right, "j int, k string, rs timestamp, re timestamp"), ["k"], ("ls", "le"), ("rs", "re"))
    ok = lambda k, a, b: k is not None and a is not None and b is not None and a < b
    want = [(i, j) for i, k, a, b in left for j, m, c, d in right if k == m and ok(k, a, b) and ok(m, c, d) and a < d and c < b]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want) and len(want) > 300


def test_interval_join_plan(spark):
    left = spark.range(5).select(F.lit("a").alias("k"), F.lit(at(0)).alias("ls"), F.lit(at(9)).alias("le"), "id")
    right = left.select("k", F.col("ls").alias("rs"), F.col("le").alias("re"), F.col("id").alias("j"))
    joined = interval_join(left, right, ["k"], ("ls", "le"), ("rs", "re"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert joined.count() == 25
    with pytest.raises(ValueError, match="both sides"):
        interval_join(left, left, ["k"], ("ls", "le"), ("ls", "le"))


def test_interval_join_spreads_a_hot_point(spark):
    """Many short spans of one key inside one long span: no cell takes more than a small part of them."""
    from demandgauge.operators import intervals as V

    n = 20_000
    short = spark.range(n).select(F.lit("hot").alias("k"), "id", F.timestamp_seconds(1_700_000_000 + F.col("id") * 1300).alias("ls"))
    short = short.withColumn("le", F.col("ls") + F.expr("INTERVAL 20 MINUTES"))
    long = spark.sql("SELECT 'hot' AS k, timestamp '2023-01-01' AS rs, timestamp '2025-01-01' AS re")
    assert interval_join(short, long, ["k"], ("ls", "le"), ("rs", "re")).count() == n
    homes = V._at_home(short, ["k"], ("ls", "le"), "_l", 3600 * 10**6), V._at_home(long, ["k"], ("rs", "re"), "_r", 3600 * 10**6)
    cells = V._cells(*homes, "_l", V._LEFT_LONG, V._RIGHT_LONG, 3600 * 10**6)
    assert cells.groupBy("k", "_cell").count().agg(F.max("count")).head()[0] < n / 6
    assert cells.count() <= 3 * n  # levels that the long span does not use are left out


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_load_equals_sums_over_pairs(spark, seed):
    """Equal to the sums over all pairs, also with repeated rows and parts of a second."""
    rng = random.Random(seed)
    keys = ["hot"] * 5 + ["x", None]
    part = lambda t: t and t + dt.timedelta(microseconds=rng.choice([0, 0, 300_000, 999_999]))
    left = [(i, k, part(a), part(b)) for i, k, a, b in spans(rng, 300, keys, 60 * 24 * 300)]
    right = [(j, k, part(a), part(b)) for j, k, a, b in spans(rng, 200, keys, 60 * 24 * 900)]
    right += right[:40]
    sides = (spark.createDataFrame(left, "i int, k string, ls timestamp, le timestamp"),
             spark.createDataFrame(right, "j int, k string, rs timestamp, re timestamp"))
    got = interval_join(*sides, ["k"], ("ls", "le"), ("rs", "re"), load=("n", "s"))
    assert got.columns == ["j", "k", "rs", "re", "n", "s"]
    ok = lambda k, a, b: k is not None and a is not None and b is not None and a < b
    whole = lambda t: (t - dt.datetime(2000, 1, 1)) // dt.timedelta(seconds=1)
    want = []
    for j, m, c, d in right:
        met = [whole(min(b, d)) - whole(max(a, c)) for _, k, a, b in left if k == m and ok(k, a, b) and ok(m, c, d) and a < d and c < b]
        if met:
            want.append((j, len(met), sum(met)))
    assert sorted((r.j, r.n, r.s) for r in got.collect()) == sorted(want) and len(want) > 50
    with pytest.raises(ValueError, match="both sides"):
        interval_join(*sides, ["k"], ("ls", "le"), ("rs", "re"), load=("j", "s"))


def test_outage_load_makes_no_pairs(spark, tmp_path):
    """2,000 sessions and 2,000 outages of one point at one time are 4 million pairs; no step of the query has more than a few rows for each."""
    from workload import time_joins

    n, day = 2000, dt.datetime(1996, 1, 1)
    spark.range(n).select((F.col("id") * 3).alias("l_orderkey"), F.lit(1).cast("bigint").alias("l_partkey"), F.lit(1).cast("bigint").alias("l_suppkey"),
                          F.lit(1).cast("bigint").alias("l_linenumber"), F.lit(20.0).alias("l_quantity"), F.lit(1.0).alias("l_extendedprice"),
                          F.lit(day).alias("l_shipdate")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(n).select((F.col("id") * 3).alias("o_orderkey"), F.lit(1).cast("bigint").alias("o_custkey"), F.lit(day).alias("o_orderdate")).write.parquet(
        str(tmp_path / "orders.parquet"))
    found = time_joins.outage_load(spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.agg(F.sum("sessions")).head()[0] > n * n / 3


def test_interval_join_makes_few_cells(spark):
    """A span of one level is offered to spans of the next level once, not to eight shares."""
    from demandgauge.operators import intervals as V

    base = spark.range(1000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 57600).alias("ls"))
    long = base.withColumn("le", F.col("ls") + F.expr("INTERVAL 10 HOURS"))
    short = base.select("k", F.col("ls").alias("rs"), (F.col("ls") + F.expr("INTERVAL 50 MINUTES")).alias("re"))
    homes = V._at_home(long, ["k"], ("ls", "le"), "_l", 3600 * 10**6), V._at_home(short, ["k"], ("rs", "re"), "_r", 3600 * 10**6)
    cells = V._cells(*homes, "_l", V._LEFT_LONG, V._RIGHT_LONG, 3600 * 10**6)
    assert cells.count() == 1000 and "_l_start" not in cells.columns
    assert interval_join(long, short, ["k"], ("ls", "le"), ("rs", "re")).count() == 1000


@pytest.mark.parametrize("tolerance", [None, 7200])
def test_asof_join_equals_plain_search(spark, tolerance):
    rng = random.Random(8)
    keys = ["hot"] * 4 + ["a", "b", None]
    left = [(i, rng.choice(keys), at(rng.choice([None, *[rng.randrange(-9000, 9000)] * 9]))) for i in range(400)]
    right = [(rng.choice(keys), at(rng.choice([None, *[rng.randrange(-9000, 6000)] * 9])), rng.randrange(5), j) for j in range(150)]
    right += [(k, t, p, 1000 + j) for k, t, p, j in right[:30]]
    got = asof_join(
        spark.createDataFrame(left, "i int, k string, t timestamp"),
        spark.createDataFrame(right, "k string, valid timestamp, price int, j int"), ["k"], "t", "valid", tie=["price", "j"], tolerance_seconds=tolerance)
    assert got.columns == ["i", "k", "t", "valid", "price", "j"]

    def last(k, t):
        fit = [(v, p, j) for m, v, p, j in right if m == k and k is not None and v is not None and t is not None and v <= t]
        best = max(fit, default=(None, None, None))
        return (None,) * 3 if tolerance and best[0] and (t - best[0]).total_seconds() > tolerance else best

    assert sorted(((r.i, r.valid, r.price, r.j) for r in got.collect()), key=lambda r: r[0]) == [(i, *last(k, t)) for i, k, t in left]


def test_asof_join_without_right_rows_or_join(spark):
    left = spark.createDataFrame([(1, "a", at(5))], "i int, k string, t timestamp")
    right = spark.createDataFrame([], "k string, valid timestamp, price int")
    joined = asof_join(left, right, ["k"], "t", "valid")
    assert [tuple(r) for r in joined.collect()] == [(1, "a", at(5), None, None)]
    assert "Join" not in joined._jdf.queryExecution().executedPlan().toString()
