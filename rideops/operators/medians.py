"""Exact medians per group without gathering a group.

Spark's ``median`` keeps the distinct values of a group in one buffer that does not spill. Here a
first pass counts values per group and coarse bucket of value, combined before the shuffle, and
finds the bucket that holds the middle; a second pass lets only the values of that bucket through,
which is a small part, and orders them. Every step is a hash aggregate, a sort or a join, so it
spills, and a group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideops.session import cut_lineage

#: Groups whose middle buckets are broadcast to the rows; of more, rows and groups are shuffled to each other.
FEW_GROUPS = 100_000
#: Buckets per doubling of a value: more of them let fewer values through, but count finer.
STEPS = 8


def value_bucket(value: Column) -> Column:
    """Monotone in the value. NaN and infinities fall into the outermost buckets, where they sort last."""
    size = F.floor(STEPS * F.log2(1 + F.least(F.abs(value), F.lit(1e300)))).cast("int")
    return F.when(value < 0, -size).when(value.isNotNull(), size)


def bucketed_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact interpolated medians, one row per key, without gathering a group.

    The second pass joins each row once, for all columns, with its group's middle buckets. They are
    checkpointed and counted first: up to ``FEW_GROUPS`` groups they are broadcast and the rows are
    not shuffled at all. The input is read twice.
    """
    keys = list(keys)
    every = range(len(columns))
    rows = df.select(*keys, *[F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(columns)])
    rows = rows.select("*", *[value_bucket(F.col(f"_m{i}")).alias(f"_b{i}") for i in every])

    def stacked(of: DataFrame, fields: Sequence[str], names: str) -> DataFrame:
        """One row per measure, without building arrays."""
        parts = ", ".join(f"{i}, " + ", ".join(f.format(i=i) for f in fields) for i in every)
        return of.select(*keys, F.expr(f"stack({len(columns)}, {parts}) as (measure, {names})"))

    counts = stacked(rows, ["_b{i}"], "bucket").filter("bucket is not null").groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.col("total") - 1
    middle = counts.withColumns({"upto": upto, "total": F.sum("n").over(group)}).withColumn("before", F.col("upto") - F.col("n")).filter(
        (F.col("before") <= F.ceil(last / 2)) & (F.col("upto") > F.floor(last / 2)))
    ends = middle.groupBy(*keys, "measure").agg(F.struct(
        F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.min("before").alias("before"), F.max("total").alias("total")).alias("_r"))
    wide = cut_lineage(ends.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == i, F.col("_r"))).alias(f"_r{i}") for i in every]))
    wide = F.broadcast(wide) if wide.count() <= FEW_GROUPS else wide

    near = stacked(rows.join(wide, keys), ["if(_b{i} between _r{i}.low and _r{i}.high, _m{i}, null)", "_r{i}.before", "_r{i}.total"], "value, before, total")
    values = near.filter("value is not null").groupBy(*keys, "measure", "value").agg(
        F.count("*").alias("n"), F.first("before").alias("before"), F.first("total").alias("total"))
    order = Window.partitionBy(*keys, "measure").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("upto", F.col("before") + F.sum("n").over(order))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (F.col("upto") > rank), F.col("value")))

    picked = values.groupBy(*keys, "measure").agg(((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("_median"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == i, F.col("_median"))).alias(columns[i]) for i in every])
