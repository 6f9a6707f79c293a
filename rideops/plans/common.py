"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from rideops.functions.columns import rounded
from rideops.operators.trip_features import scored_trips, with_airport_flag
from rideops.plans.scored import zone_bin_joined, zone_bin_scored
from rideops.sources import adapters
from rideops.sources.trips import normalize_trips

#: Support threshold of the score queries: the test tables hold a few trips per zone and bin.
TEST_MIN_TRIPS = 5

_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """One persisted instance per session and input of a result several queries start from.

    It spills to disk and is rebuilt from its lineage when an executor is lost.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SHARED:
        _SHARED[key] = build().persist(StorageLevel.MEMORY_AND_DISK)
    return _SHARED[key]


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_airport_flag(adapters.zones(spark, sf_dir))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_trips(adapters.trips(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_trips(trips(spark, sf_dir), zones(spark, sf_dir))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "joined", lambda: zone_bin_joined(trips(spark, sf_dir), zones(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "scored", lambda: zone_bin_scored(trips(spark, sf_dir), zones(spark, sf_dir), min_trips=TEST_MIN_TRIPS))


def r6(*names: str, digits: int = 6) -> list[Column]:
    return [rounded(F.col(n), digits).alias(n) for n in names]
