"""Bucketed order operators against plain windows, with a key that holds most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from rideops.operators.medians import bucketed_medians
from rideops.operators.ordered import latest_per_key, with_global_rank, with_previous, with_running


def _rows(spark, n=600):
    rng = random.Random(7)
    data = [(1 if rng.random() < 0.6 else rng.randint(2, 6), rng.randint(0, 20_000), i, rng.choice([-2.5, 0.0, 1.0, 7.25, rng.uniform(-50, 5000)]))
            for i in range(n)]
    return spark.createDataFrame(data, "k long, at long, id long, v double")


def _same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_with_previous(spark):
    df = _rows(spark)
    w = Window.partitionBy("k").orderBy("at", "id")
    want = df.withColumns({"prev_at": F.lag("at").over(w), "prev_v": F.lag("v").over(w)})
    _same(with_previous(df, "k", "at", "id", ["at", "v"], 500).select(want.columns), want)


def test_with_running(spark):
    df = _rows(spark)
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.floor("v")
    for kind, fn in (("sum", F.sum), ("min", F.min), ("max", F.max)):
        _same(with_running(df, "k", "at", ["at", "id"], {"r": (kind, whole)}, 500), df.withColumn("r", fn(whole).over(w)))


def test_global_rank(spark):
    df = _rows(spark)
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("v"), "id")
    _same(with_global_rank(df, "v", "id").withColumn("rank_position", F.col("rank_position").cast("int")), df.withColumn("rank_position", F.row_number().over(w)))


def test_global_rank_over_tie_ranges(spark):
    df = spark.createDataFrame([(float(i % 2), i * 40_000) for i in range(20)], "v double, id long")
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("v"), "id")
    _same(with_global_rank(df, "v", "id").withColumn("rank_position", F.col("rank_position").cast("int")), df.withColumn("rank_position", F.row_number().over(w)))


def test_latest_per_key(spark):
    df = _rows(spark)
    w = Window.partitionBy("k").orderBy(F.desc("at"), F.desc("id"))
    _same(latest_per_key(df, "k", ["at", "id"]), df.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n"))


def test_bucketed_medians(spark):
    df = _rows(spark).withColumn("w", F.when(F.col("id") % 3 != 0, F.col("v") * 2 + F.col("id")))
    want = df.groupBy("k").agg(F.round(F.median("v"), 9).alias("v"), F.round(F.median("w"), 9).alias("w"))
    got = bucketed_medians(df, ["k"], ["v", "w"]).select("k", F.round("v", 9).alias("v"), F.round("w", 9).alias("w"))
    _same(got, want)


def test_bucketed_medians_of_one_and_two_values(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 1.0), (2, 1000.0)], "k long, v double")
    assert {r.k: r.v for r in bucketed_medians(df, ["k"], ["v"]).collect()} == {1: 4.0, 2: 500.5}
