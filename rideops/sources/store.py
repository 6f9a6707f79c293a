"""Inventory of source files, timelines, and the month store of scored zone-bins."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rideops.functions import times
from rideops.session import shared_folder
from rideops.sources import footers

# How a month appears in a file name.
MONTH_PATTERN = r"((?:19|20)\d{2})[-_]?(0[1-9]|1[0-2])"


def parquet_inventory(spark: SparkSession, paths: Sequence[str], time_column: str = "pickup_datetime") -> DataFrame:
    """Rows and time span per file, the month in its name, and warnings about overlaps.

    Only footers are read, and the time column of files whose footers do not tell the span.
    """
    return with_inventory_warnings(with_month(footers.file_spans(spark, paths, time_column)))


def with_month(spans: DataFrame) -> DataFrame:
    year, month = F.regexp_extract("file_name", MONTH_PATTERN, 1), F.regexp_extract("file_name", MONTH_PATTERN, 2)
    return spans.withColumn("month_key", F.when(year != "", F.concat_ws("-", year, month)))


def with_inventory_warnings(spans: DataFrame) -> DataFrame:
    """Flag files that share a month or have the same span. One row per file goes in."""
    month = F.count("*").over(Window.partitionBy("month_key"))
    span = F.count("*").over(Window.partitionBy("first_epoch", "last_epoch"))
    return spans.withColumns({"same_month": F.col("month_key").isNotNull() & (month > 1), "same_span": span > 1})


def source_signature(inventory: DataFrame, key: str = "month_key") -> DataFrame:
    """A hash per key over its files; the list holds one entry per file."""
    entry = F.struct("file_name", "first_epoch", "last_epoch", "rows")
    return inventory.groupBy(key).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(entry))), 256).alias("signature"))


def stale(current: DataFrame, stored: DataFrame, key: str = "month_key") -> DataFrame:
    """Keys whose signature is new or differs from the stored one."""
    old = stored.select(key, F.col("signature").alias("stored_signature"))
    return current.join(old, key, "left").withColumn("is_stale", ~F.col("signature").eqNullSafe(F.col("stored_signature")))


def timeline(scored: DataFrame) -> DataFrame:
    """Distinct bins in order, with date, weekday and label."""
    date = times.epoch_date(F.col("bin_local_epoch"))
    return scored.select("bin_local_epoch").distinct().withColumns({
        "frame_date": date, "weekday_name": times.weekday_name(date, long=True), "time_label": times.hhmm(F.col("bin_local_epoch"))}).orderBy("bin_local_epoch")


def month_bins(months: DataFrame, bin_minutes: int = 20) -> DataFrame:
    """All bins of the calendar months in ``month_key`` (yyyy-MM), with weekday and 12 h label."""
    first = F.to_date(F.concat("month_key", F.lit("-01")))
    start, end = times.date_epoch(first), times.date_epoch(F.add_months(first, 1))
    bins = months.select("month_key", F.explode(F.sequence(start, end - 60 * bin_minutes, F.lit(60 * bin_minutes).cast("long"))).alias("bin_local_epoch"))
    date = times.epoch_date(F.col("bin_local_epoch"))
    index = (F.pmod("bin_local_epoch", F.lit(times.DAY)) / (60 * bin_minutes)).cast("int")
    return bins.withColumns({"frame_date": date, "weekday_name": times.weekday_name(date, long=True),
                             "time_label": F.lpad(times.bin_label(index, bin_minutes), 8, "0")})


def month_key(epoch: Column) -> Column:
    return F.date_format(times.epoch_date(epoch), "yyyy-MM")


def write_month(scored: DataFrame, path: str) -> None:
    """Write by month, replacing only the months present; rows sorted for row-group pruning."""
    (scored.withColumn("month_key", month_key(F.col("bin_local_epoch")))
     .repartition("month_key", F.floor(F.col("bin_local_epoch") / 86400)).sortWithinPartitions("bin_local_epoch", "zone_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month_key").parquet(path))


def read_bin(spark: SparkSession, path: str, month: str, bin_local_epoch: int | Column) -> DataFrame:
    """One bin: the partition is pruned by month, row groups by the bin's statistics."""
    return spark.read.parquet(path).filter((F.col("month_key") == month) & (F.col("bin_local_epoch") == bin_local_epoch))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the session."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
