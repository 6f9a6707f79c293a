"""The composed zone-bin scoring plan."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

from rideops.operators import ranks, scoring, trip_features, zone_bins
from rideops.session import cut_lineage


@contextmanager
def held_rows(prepared: DataFrame) -> Iterator[DataFrame]:
    """The columns of the trips that zone-bins read, on the executors' disks until they have been read.

    Counts and both passes of the medians read them, with different columns, so that without this
    the trips would be joined and shuffled three times.
    """
    packed = zone_bins.packed_rows(prepared).persist(StorageLevel.DISK_ONLY)
    try:
        yield zone_bins.unpacked_rows(packed)
    finally:
        packed.unpersist()


def zone_bin_facts(trips: DataFrame, zones: DataFrame, *, bin_minutes: int = 20, slice_hours: int | None = 6,
                   source_tz: str | None = "UTC") -> DataFrame:
    """Filled zone-bins from normalised trips."""
    prepared = trip_features.scored_trips(trips, zones, bin_minutes, source_tz)
    with held_rows(prepared) as rows:
        actual = cut_lineage(zone_bins.zone_bin_agg(rows))  # read for the grid and for the facts
    return zone_bins.zone_bin_filled(actual, zones, slice_hours)


def zone_bin_joined(trips: DataFrame, zones: DataFrame, *, bin_minutes: int = 20, slice_hours: int | None = 6,
                    edge_lookup: str = "row", source_tz: str | None = "UTC") -> DataFrame:
    """Filled zone-bins with flows and densities.

    Trips are scanned once; their rows are held for the origin-destination counts with their flags,
    and for the medians. Both results are small next to the trips and read more than once, with
    different columns, so Spark could not reuse their exchanges: they are checkpointed.
    """
    prepared = trip_features.scored_trips(trips, zones, bin_minutes, source_tz)
    with held_rows(prepared) as rows:
        counts = cut_lineage(zone_bins.od_counts(rows))
        actual = cut_lineage(zone_bins.zone_bin_agg(rows, counts))
    filled = zone_bins.zone_bin_filled(actual, zones, slice_hours)
    return zone_bins.with_flows(filled, zone_bins.od_edges(counts), slice_hours, edge_lookup)


def zone_bin_scored(trips: DataFrame, zones: DataFrame, *, min_trips: int = scoring.MIN_TRIPS, **options) -> DataFrame:
    """Scored zone-bins of every profile. Sort when writing, not here.

    The input of the ranks is checkpointed too: it is one row per zone and bin, and without the
    cut every finished stage would make AQE plan some three hundred expressions again.
    """
    joined = zone_bin_joined(trips, zones, **options)
    # A number keeps AQE from folding these few, compute-heavy rows into one task.
    tasks = int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = cut_lineage(joined.repartition(tasks, ranks.BIN))
    return scoring.with_ratings(scoring.with_scores(ranks.with_ranks(joined), min_trips))
