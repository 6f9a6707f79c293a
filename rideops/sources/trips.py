"""Trip records: scan, lenient typing and optional columns."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COLUMNS = {"DOLocationID": "int", "request_datetime": "timestamp", "airport_fee": "double", "driver_pay": "double", "trip_time": "double", "trip_miles": "double"}
NAMES = {"DOLocationID": "drop_zone_id"}
SHARED_FLAGS = ("shared_match_flag", "shared_request_flag")


def read_trips(spark: SparkSession, paths: Sequence[str] | str, start: str | None = None,
               end: str | None = None) -> DataFrame:
    """Read trip parquet. Bounds compare the raw column, so they reach the scan as filters.

    Each path (a month's file, folder or pattern) is read with the schema in its own footers:
    months may differ in columns, types and spelling. Paths of one schema share a scan, and the
    scans are united after their columns have been typed.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    groups: dict[str, list[str]] = {}
    for path in paths:
        groups.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
    parts = [normalize_trips(spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*group), start, end) for schema, group in groups.items()]
    return reduce(DataFrame.unionByName, parts)


def normalize_trips(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Typed trips without null zone or pickup.

    Values that do not parse become null. Missing columns become typed nulls; the shared flag is
    the first non-null of those present, else 0. Bounds are UTC, half open.
    """
    present = {c.lower() for c in df.columns}
    kinds = {c.lower(): t for c, t in df.dtypes}

    def typed(name: str, kind: str) -> Column:
        if name.lower() not in present:
            return F.lit(None).cast(kind)
        return F.col(name).cast(kind) if kinds[name.lower()].startswith("timestamp") else F.col(name).try_cast(kind)

    pickup_type = kinds["pickup_datetime"]
    pickup = F.col("pickup_datetime") if pickup_type.startswith("timestamp") else F.col("pickup_datetime").try_cast("timestamp")
    kept = df.filter(typed("PULocationID", "int").isNotNull() & pickup.isNotNull())
    bound = pickup_type if pickup_type.startswith("timestamp") else "timestamp"
    if start is not None:
        kept = kept.filter(pickup >= F.lit(start).cast(bound))
    if end is not None:
        kept = kept.filter(pickup < F.lit(end).cast(bound))
    flags = [F.col(c).try_cast("int") for c in SHARED_FLAGS if c in present]
    return kept.select(
        typed("PULocationID", "int").alias("zone_id"), pickup.cast("timestamp").alias("pickup_datetime"),
        *[typed(c, t).alias(NAMES.get(c, c)) for c, t in COLUMNS.items()], F.coalesce(*flags, F.lit(0)).alias("shared_flag"))
