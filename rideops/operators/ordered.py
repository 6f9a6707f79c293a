"""Row order without one big partition: previous rows and global ranks under skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideops.session import cut_lineage


def with_bucket(df: DataFrame, at: str, bucket_seconds: int = 3600) -> DataFrame:
    """Add the time bucket once for several of the functions below.

    They then share one hash partitioning by key and bucket, so the rows move only once. Drop
    ``_bucket`` at the end.
    """
    return df.withColumn("_bucket", F.floor(F.col(at) / bucket_seconds))


def _bucketed(df: DataFrame, at: str, bucket_seconds: int) -> tuple[DataFrame, list[str]]:
    if "_bucket" in df.columns:
        return df, []
    return with_bucket(df, at, bucket_seconds), ["_bucket"]


def with_previous(df: DataFrame, key: str, at: str, tie: str, columns: Sequence[str],
                  bucket_seconds: int = 3600) -> DataFrame:
    """Add ``prev_<column>`` from the row before, per ``key`` in (``at``, ``tie``) order.

    The window is partitioned by key and time bucket, so a key holding a large part of all rows
    is spread over its buckets. The first row of a bucket takes the last row of the key's
    previous bucket, carried by an aggregate with one row per key and bucket.
    """
    packed = F.struct(*columns)
    rows, drop = _bucketed(df, at, bucket_seconds)
    inside = Window.partitionBy(key, "_bucket").orderBy(at, tie)
    tails = rows.groupBy(key, "_bucket").agg(F.max_by(packed, F.struct(at, tie)).alias("_tail"))
    before = F.lag("_tail").over(Window.partitionBy(key).orderBy("_bucket"))
    tails = tails.withColumn("_before", before).select(key, "_bucket", "_before")
    out = rows.withColumn("_prev", F.lag(packed).over(inside)).join(tails, [key, "_bucket"], "left")
    prev = F.coalesce("_prev", "_before")
    return out.withColumns({f"prev_{c}": prev.getField(c) for c in columns}).drop(*drop, "_prev", "_before")


def with_global_rank(df: DataFrame, value: str, tie: str, name: str = "rank_position",
                     groups: Sequence[str] = ()) -> DataFrame:
    """1-based position in (value descending, tie ascending) order, per ``groups``.

    A window over everything would be one task. Instead the rank is a sum of counts: of rows
    with a larger value, of rows with the same value and a smaller tie range, and the position
    inside that range. Values are counted by coarse bucket (64 per doubling) first, so no window
    sees more than the buckets, the distinct values of a bucket, or one tie range. ``tie`` is an
    integer, unique per group. The input is read several times and therefore checkpointed.
    """
    groups = list(groups)
    v = F.col(value).cast("double")
    rows = cut_lineage(df).withColumns({
        "_v": v, "_c": (F.signum(v) * F.floor(64 * F.log2(1 + F.abs(v)))).cast("long"),
        "_t": F.floor(F.col(tie) / 65536)})
    cells = rows.groupBy(*groups, "_c", "_v", "_t").agg(F.count("*").alias("_n"))
    unbounded = (Window.unboundedPreceding, -1)
    cells = cells.withColumn("_in_value", F.sum("_n").over(
        Window.partitionBy(*groups, "_c", "_v").orderBy("_t").rowsBetween(*unbounded)))
    values = cells.groupBy(*groups, "_c", "_v").agg(F.sum("_n").alias("_n")).withColumn("_in_bucket", F.sum("_n").over(
        Window.partitionBy(*groups, "_c").orderBy(F.desc("_v")).rowsBetween(*unbounded)))
    all_buckets = Window.partitionBy(*(groups or [F.lit(1)])).orderBy(F.desc("_c")).rowsBetween(*unbounded)
    buckets = values.groupBy(*groups, "_c").agg(F.sum("_n").alias("_n")).withColumn("_above", F.sum("_n").over(all_buckets))
    offsets = (
        cells.select(*groups, "_c", "_v", "_t", "_in_value")
        .join(values.select(*groups, "_c", "_v", "_in_bucket"), [*groups, "_c", "_v"])
        .join(buckets.select(*groups, "_c", "_above"), [*groups, "_c"])
        .select(*groups, "_v", "_t", sum((F.coalesce(c, F.lit(0)) for c in ("_in_value", "_in_bucket", "_above")), F.lit(0)).alias("_offset")))
    position = F.row_number().over(Window.partitionBy(*groups, "_v", "_t").orderBy(tie))
    return rows.withColumn("_p", position).join(offsets, [*groups, "_v", "_t"]).withColumn(
        name, F.col("_offset") + F.col("_p")).drop("_v", "_c", "_t", "_p", "_offset")


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the greatest order per key, by a combinable aggregate rather than a sort."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*")


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def with_running(df: DataFrame, key: str | Sequence[str], at: str, order: Sequence[str], values: dict[str, tuple[str, Column]],
                 bucket_seconds: int = 3600, strict: bool = False) -> DataFrame:
    """Running aggregates per key, spread over time buckets; a row counts itself unless ``strict``.

    ``values`` maps a new column to ``(kind, value)`` with kind sum, min or max. Inside a bucket
    each is a window; across buckets it is the same function over one row per key and bucket, so
    no task sees all rows of a key. The input is read twice: pass all values of one level
    together and cut the lineage between dependent levels.
    """
    keys, functions = _keys(key), {"sum": F.sum, "min": F.min, "max": F.max}
    rows, drop = _bucketed(df, at, bucket_seconds)
    rows = rows.withColumns({f"_v_{n}": v for n, (_, v) in values.items()})
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, "_bucket").agg(*[functions[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in values.items()])
    carry = carry.select(*keys, "_bucket", *[functions[k](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (k, _) in values.items()])
    out = rows.withColumns({f"_r_{n}": functions[k](f"_v_{n}").over(inside) for n, (k, _) in values.items()}).join(carry, [*keys, "_bucket"], "left")

    def total(name: str, kind: str) -> Column:
        run, held = F.col(f"_r_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            return F.coalesce(run, F.lit(0)) + F.coalesce(held, F.lit(0))
        return (F.least if kind == "min" else F.greatest)(run, held)

    temporary = [f"_{part}_{n}" for n in values for part in "vrc"]
    return out.withColumns({n: total(n, k) for n, (k, _) in values.items()}).drop(*drop, *temporary)
