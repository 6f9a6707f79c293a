"""Mixing sources to target weights: capped water-filling and seeded repetitions, all in Spark SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideops.llm.common import WORD
from rideops.session import cut_lineage

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: Hexadecimal digits of the sampling key that name a bucket: 4096 buckets for each source.
BUCKET_DIGITS = 3
#: A plan is broadcast up to this size: its source names and a fixed part for each row. Above it,
#: the plan is repeated for this many salts.
BROADCAST_BYTES, PLAN_ROW_BYTES, SALTS = 32 << 20, 64, 32


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A uniform key that depends on the seed and the id alone; repeated ids share it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def weighted_sources(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Add each source's weight by its place in code-point order, null last.

    Sources are sorted over range partitions, and each adds the counts of the partitions before
    it, so that the number of sources is not bounded by one task.
    """
    placed = cut_lineage(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    index = (F.col("_before") + F.col("_in") - 1) % len(weights)
    return placed.withColumn("_in", inside).join(parts.drop("count"), "_part").withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (index + 1).cast("int"))).drop("_part", "_before", "_in")


def source_targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target``: shares of the total by weight, no more than ``max_epochs`` sizes each.

    Each round clamps the sources whose share exceeds their limit and shares the rest among the
    others; the level rises until no further source is clamped. A round is one aggregate of one
    row. All sizes 0: all targets 0.
    """
    sources = cut_lineage(sources)
    limit, level, clamped = F.col("source_size") * max_epochs, 0.0, -1
    while True:
        held = limit <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(held, limit)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0)).alias("free"), F.coalesce(F.sum(held.cast("int")), F.lit(0)).alias("n")).first()
        if row.n == clamped or not row.free:
            break
        level, clamped = (row.total - row.held) / row.free, row.n
    return sources.withColumn("target", F.when(limit <= F.lit(level) * F.col("weight"), limit.cast("double")).otherwise(F.lit(level) * F.col("weight")))


def mixing_plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per source: size, weight, target, whole repetitions and the last key taken once more.

    ``sized`` has doc_id, source and size. Documents of a source are ordered by their keys; those
    whose middle lies within the fractional rest are taken once more, so a source misses its
    target by half a document at most. Sizes are summed by key bucket first and only the bucket
    in which the rest ends is ordered, so one source may hold any part of all rows.
    """
    cells = sized.withColumns({"_key": sampling_key(seed=seed)}).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    buckets = cut_lineage(cells.groupBy("source", "_bucket").agg(F.sum("size").alias("_size")))
    targets = source_targets(weighted_sources(buckets.groupBy("source").agg(F.sum("_size").alias("source_size")), weights), max_epochs)
    size = F.col("source_size")
    targets = cut_lineage(targets.withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
                          .withColumn("_rest", F.col("target") - F.col("whole") * size))
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = buckets["source"].eqNullSafe(targets["source"])
    ends = (buckets.withColumn("_upto", F.sum("_size").over(upto)).join(targets.select("source", "_rest"), same)
            .where(F.col("_upto") > F.col("_rest"))
            .groupBy(buckets["source"]).agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_size")).alias("_start"), "_rest")).alias("_end"))
            .select("source", "_end.*"))
    inside = Window.partitionBy(cells["source"], cells["_bucket"]).orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = (cells.groupBy("source", "_bucket", "_key").agg(F.sum("size").alias("_size")).alias("c")
             .join(ends.alias("e"), F.col("c.source").eqNullSafe(F.col("e.source")) & (F.col("c._bucket") == F.col("e._bucket")))
             .select("c.*", "e._start", "e._rest").withColumn("_upto", F.col("_start") + F.sum("_size").over(inside.partitionBy("source", "_bucket")))
             .where(2 * F.col("_upto") - F.col("_size") <= 2 * F.col("_rest"))
             .groupBy("source").agg(F.max("_key").alias("_key")))
    last = (ends.alias("e").join(taken.alias("t"), F.col("e.source").eqNullSafe(F.col("t.source")), "left")
            .select("e.source", F.coalesce("t._key", "e._bucket").alias("last_key")))
    # a source without an end bucket has no document beyond its rest: every key is taken
    return (targets.alias("p").join(last.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")), "left")
            .select("p.source", "p.source_size", "p.weight", "p.target", "p.whole",
                    F.coalesce("l.last_key", F.lit("g")).alias("last_key")))


def with_copies(docs: DataFrame, plan: DataFrame, seed: str = SEED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add the plan's columns and ``copies``, how often the mix takes each document.

    The plan has one row per source. It is broadcast after its size has been measured, so that no
    text is shuffled. A plan above ``broadcast_bytes`` is repeated once per salt, and documents
    meet it by source and salt, so that the rows of one source are spread over tasks.
    """
    plan = cut_lineage(plan)
    measured = plan.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + PLAN_ROW_BYTES), F.lit(0))).first()[0]
    same = F.col("_d.source").eqNullSafe(F.col("_p.source"))
    if measured <= broadcast_bytes:
        plan = F.broadcast(plan)
    else:
        plan = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same &= F.pmod(F.xxhash64("_d.doc_id"), F.lit(SALTS)) == F.col("_p._salt")
    once_more = sampling_key(seed=seed) <= F.col("_p.last_key")
    return (docs.alias("_d").join(plan.alias("_p"), same, "left")
            .select("_d.*", F.col("_p.source_size"), F.col("_p.target"), (F.col("_p.whole") + once_more.cast("long")).alias("copies")))


def mix(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document: one row per input row.

    Null texts have size 0; sources are compared null-safe, null being a source of its own, last
    in order. Repeated ids share a key and so their fate. An empty table gives an empty result.
    Columns besides doc_id, text and source are not looked at.
    """
    sized = cut_lineage(docs.select("doc_id", "source", word_count().alias("size")))
    out = with_copies(sized, mixing_plan(sized))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight
  FROM d GROUP BY source),
steps AS (
  SELECT *, row_number() OVER o AS place,
         (sum(source_size) OVER () - coalesce(sum({MAX_EPOCHS} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM s WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
lv AS (SELECT coalesce(arg_min(level, place), 0) AS level FROM steps WHERE {MAX_EPOCHS} * source_size > level * weight),
t AS (
  SELECT source, source_size,
         CASE WHEN {MAX_EPOCHS} * source_size <= lv.level * weight THEN ({MAX_EPOCHS} * source_size)::DOUBLE ELSE lv.level * weight END AS target
  FROM s, lv),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key RANGE UNBOUNDED PRECEDING) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.key) AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
r AS (SELECT *, (whole + CASE WHEN 2 * upto - own <= 2 * rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM r
"""
