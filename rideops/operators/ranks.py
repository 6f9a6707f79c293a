"""Percentile ranks inside a bin.

A bin holds one row per zone, a few hundred at most, so these windows partition evenly and
stay small at any number of trips. All ranks share the partitioning: one shuffle by bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = "bin_local_epoch"


def _order(name: str) -> list[Column]:
    return [F.col(name).asc_nulls_last(), F.col("zone_id").asc()]


def _scaled(row: Column, n: Column) -> Column:
    return F.when(n <= 1, F.lit(0.0)).otherwise((row - 1) / (n - 1))


def rank_in_bin(name: str) -> Column:
    """Rank among all zones of the bin, nulls last, ties by zone id."""
    w = Window.partitionBy(BIN)
    return _scaled(F.row_number().over(w.orderBy(*_order(name))), F.count("*").over(w))


def rank_nullable(name: str) -> Column:
    """Rank among the non-null values; null stays null. Nulls sort last, so they do not shift it."""
    w = Window.partitionBy(BIN)
    rank = _scaled(F.row_number().over(w.orderBy(*_order(name))), F.count(F.col(name)).over(w))
    return F.when(F.col(name).isNotNull(), rank)


def rank_share(name: str) -> Column:
    """Row number over all zones, scaled by the number of non-null values; null stays null."""
    return rank_nullable(name)


# Rank column -> source column, by kind.
ALL_ROWS = {
    "pickup_friction_n": "median_request_min",
    "short_trip_n": "short_trip_share",
    "shared_ride_n": "shared_ride_share",
    "downstream_n": "downstream_value_raw",
}
NON_NULL = {
    "pay_n": "median_driver_pay",
    "pay_per_min_n": "median_pay_per_min",
    "pay_per_mile_n": "median_pay_per_mile",
}
SHARE = {
    "long_trip_n": "long_trip_share",
    "balanced_trip_n": "balanced_trip_share",
    "same_zone_n": "same_zone_share",
    "airport_exit_n": "airport_exit_share",
    "out_of_network_n": "out_of_network_share",
    "short_external_6mi_n": "short_external_share_6mi",
    "short_external_8mi_n": "short_external_share_8mi",
    "long_external_n": "long_external_share",
}


def demand_guard(name: str, pickups: str, rank: Column) -> Column:
    """Rank forced to 0 where nothing was picked up or the value is null."""
    return F.when((F.col(pickups) <= 0) | F.col(name).isNull(), F.lit(0.0)).otherwise(rank)


DEMAND = {
    "demand_now_n": ("pickups_now", "pickups_now"),
    "demand_next_n": ("pickups_next", "pickups_next"),
    "density_now_n": ("pickups_per_sq_mile_now", "pickups_now"),
    "density_next_n": ("pickups_per_sq_mile_next", "pickups_next"),
}


def with_ranks(df: DataFrame) -> DataFrame:
    columns: dict[str, Column] = {}
    for out, (name, pickups) in DEMAND.items():
        rank = rank_in_bin(name) if name == pickups else rank_nullable(name)
        columns[out] = demand_guard(name, pickups, rank)
    columns.update({out: rank_nullable(c) for out, c in NON_NULL.items()})
    columns.update({out: rank_in_bin(c) for out, c in ALL_ROWS.items()})
    columns.update({out: rank_share(c) for out, c in SHARE.items()})
    return df.withColumns(columns)
