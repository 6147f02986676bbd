import math
import random

from pyspark.sql import DataFrame, Window, functions as F

from demandgauge.operators import pressure as P, ranking as R


def with_percentiles_by_window(
    df: DataFrame,
    cume: dict[str, str] | None = None,
    average: dict[str, str] | None = None,
    descending: dict[str, str] | None = None,
) -> DataFrame:
    """The same ranks with plain windows over all rows: what the nested form is held against."""
    def ascending(c: str):
        return Window.orderBy(F.col(c).asc_nulls_first())

    for c, new in (cume or {}).items():
        df = df.withColumn(new, F.cume_dist().over(ascending(c)))
    for c, new in (average or {}).items():
        ties = F.count(F.lit(1)).over(Window.partitionBy(c))
        place = F.rank().over(Window.orderBy(F.col(c).asc_nulls_last())) + (ties - 1) / F.lit(2.0)
        known = F.count(c).over(Window.partitionBy())
        df = df.withColumn(new, F.when(F.col(c).isNotNull(), place / known))
    for c, new in (descending or {}).items():
        df = df.withColumn(
            new, F.rank().over(Window.orderBy(F.col(c).desc_nulls_last())).cast("long"))
    return df


def ranked(spark, values, form=R.with_percentiles):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").repartition(3)
    out = form(df, cume={"v": "c"}, average={"v": "a"}, descending={"v": "d"})
    return [(r.c, r.a, r.d) for r in out.orderBy("i").collect()]


def test_ties_and_nulls(spark):
    got = ranked(spark, [1.0, 1.0, 2.0, None, 5.0])
    assert [g[0] for g in got] == [0.6, 0.6, 0.8, 0.2, 1.0]
    assert [g[1] for g in got] == [0.375, 0.375, 0.75, None, 1.0]
    assert [g[2] for g in got] == [3, 3, 2, 5, 1]


def test_equals_plain_windows(spark):
    rng = random.Random(3)
    values = [rng.choice([None, 0.0, -0.0, 1.0, rng.random(), -rng.random(), rng.gauss(0, 1e9), 1e-300 * rng.random()])
              for _ in range(800)]
    near = 0.3
    for _ in range(100):  # neighbours in the last bit
        near = math.nextafter(near, 1)
        values.append(near)
    values += [float("inf"), float("-inf"), 5e-324, -5e-324, 1.7e308]
    assert ranked(spark, values) == ranked(spark, values, with_percentiles_by_window)


def test_no_window_over_all_rows(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("v"))
    plan = R.value_ranks(df, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_nan_is_missing(spark):
    nan = float("nan")
    assert ranked(spark, [1.0, nan, 2.0, None]) == ranked(spark, [1.0, None, 2.0, None])
    df = spark.createDataFrame([("a", 1.0, nan), ("b", nan, 2.0), ("c", 2.0, 1.0), ("d", None, None)], "cp_id string, saturation_rate double, utilisation double")
    plan = P.rank_points(df)
    assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {r.cp_id: r.pressure_rank for r in plan.collect()}
    assert got["c"] == 1 and got["d"] == 4


def test_score_and_rank_agree_between_forms(spark):
    df = spark.range(300).select(
        F.col("id").cast("string").alias("cp_id"), (F.col("id") * 7 % 31).cast("double").alias("saturation_rate"),
        F.when(F.col("id") % 10 != 0, (F.col("id") * 11 % 17).cast("double")).alias("utilisation"))
    pick = ["cp_id", "pressure_score", "pressure_rank"]
    wide = P.rank_points(df).select(*pick).orderBy("cp_id").collect()
    plain = P.rank_points(df, ranks=with_percentiles_by_window).select(*pick).orderBy("cp_id").collect()
    assert wide == plain
    assert min(r.pressure_rank for r in wide) == 1
