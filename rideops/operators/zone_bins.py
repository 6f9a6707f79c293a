"""Zone x bin facts: aggregation, gap fill, next bin, flows and downstream value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideops.functions.columns import clip, weighted_average_skip_null, zero_if_null
from rideops.operators.medians import bucketed_medians

KEYS = ["zone_id", "bin_local_epoch"]
MEDIANS = {
    "median_driver_pay": "driver_pay",
    "median_pay_per_min": "pay_per_min",
    "median_pay_per_mile": "pay_per_mile",
    "median_request_min": "request_min",
}
SHARES = {
    "short_trip_share": "is_short",
    "shared_ride_share": "is_shared",
    "long_trip_share": "is_long",
    "balanced_trip_share": "is_balanced",
    "same_zone_share": "is_same_zone",
    "airport_exit_share": "is_airport_exit",
    "out_of_network_share": "is_out_of_network",
    "short_external_share_6mi": "is_short_external_6mi",
    "short_external_share_8mi": "is_short_external_8mi",
    "long_external_share": "is_long_external",
}
# Medians and flow values are rounded to this many places, so that the ranks built on them do
# not depend on the order in which doubles were added.
STABLE_DIGITS = 9


def packed_rows(trips: DataFrame) -> DataFrame:
    """What zone-bins take from each trip, its flags as bits of one number."""
    flags = sum((F.col(c) * (1 << i) for i, c in enumerate(SHARES.values())), F.lit(0))
    return trips.select(*KEYS, "drop_zone_id", "is_network_drop", flags.alias("_flags"), *MEDIANS.values())


def unpacked_rows(packed: DataFrame) -> DataFrame:
    return packed.withColumns({c: F.shiftright("_flags", i).bitwiseAND(1) for i, c in enumerate(SHARES.values())}).drop("_flags")


def zone_bin_agg(trips: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Count, four medians and ten shares per pickup zone and bin.

    Counts and shares are sums over ``counts`` (:func:`od_counts`, made here if not given); the
    medians take one scan of their four columns.
    """
    counts = od_counts(trips) if counts is None else counts
    facts = counts.groupBy(*KEYS).agg(F.sum("trips").alias("pickups_now"), *[F.sum(c).alias(c) for c in SHARES.values()])
    facts = facts.select(*KEYS, "pickups_now", *[(F.col(c) / F.col("pickups_now")).alias(name) for name, c in SHARES.items()])
    trips = trips.withColumn("request_min", F.when(F.col("request_min") >= 0, F.col("request_min")))
    middles = bucketed_medians(trips, KEYS, list(MEDIANS.values())).select(
        *KEYS, *[F.round(c, STABLE_DIGITS).alias(name) for name, c in MEDIANS.items()])
    return facts.join(middles, KEYS, "left").select(*KEYS, "pickups_now", *MEDIANS, *SHARES)


def slice_of(epoch: Column, slice_hours: int | None) -> Column:
    """The slice a local bin belongs to; look-ahead never crosses it. ``None``: one slice."""
    return F.lit(0).cast("long") if slice_hours is None else F.floor(epoch / (slice_hours * 3600)).cast("long")


def zone_bin_grid(bins: DataFrame, zones: DataFrame) -> DataFrame:
    """Every non-airport zone in every observed bin.

    The zone map is a fixed dimension (a few hundred rows): it becomes one array, computed as
    a scalar subquery and exploded per bin, so no join is involved.
    """
    zone = F.struct("zone_id", "zone_name", "borough_name", "zone_area_sq_miles", "centroid_latitude")
    array = zones.filter(~F.col("airport_excluded")).agg(F.sort_array(F.collect_list(zone))).scalar()
    return bins.select("bin_local_epoch").distinct().select("bin_local_epoch", F.explode(array).alias("z")).select(
        "z.*", "bin_local_epoch")


def next_bin_pickups(actual: DataFrame, slice_hours: int | None = 6) -> DataFrame:
    """Pickups of the zone's next observed bin in the slice, else its own."""
    w = Window.partitionBy("zone_id", slice_of(F.col("bin_local_epoch"), slice_hours)).orderBy("bin_local_epoch")
    return actual.withColumn("pickups_next", F.coalesce(F.lead("pickups_now").over(w), F.col("pickups_now")))


def zone_bin_filled(actual: DataFrame, zones: DataFrame, slice_hours: int | None = 6) -> DataFrame:
    """Grid left-joined to the observed zone-bins; counts and shares default to 0."""
    grid = zone_bin_grid(actual, zones)
    filled = grid.join(next_bin_pickups(actual, slice_hours), KEYS, "left")
    return filled.select(
        "zone_id", "bin_local_epoch", "zone_name", "borough_name", "zone_area_sq_miles", "centroid_latitude",
        F.coalesce("pickups_now", F.lit(0)).alias("pickups_now"),
        F.coalesce("pickups_next", F.lit(0)).alias("pickups_next"),
        *MEDIANS, *[zero_if_null(s).alias(s) for s in SHARES],
    )


def od_counts(trips: DataFrame) -> DataFrame:
    """Trips and flagged trips per origin, destination and bin; combines before the shuffle."""
    return trips.groupBy("zone_id", "drop_zone_id", "bin_local_epoch", "is_network_drop").agg(
        F.count("*").alias("trips"), *[F.sum(c).alias(c) for c in SHARES.values()])


def od_edges(counts: DataFrame) -> DataFrame:
    """Origin to scored destination per bin, with the share of the origin's total."""
    edges = counts.filter(F.col("is_network_drop") == 1).select(
        "zone_id", "drop_zone_id", "bin_local_epoch", F.col("trips").alias("edge_trips"))
    total = F.sum("edge_trips").over(Window.partitionBy(*KEYS))
    return edges.withColumn("edge_total", total).withColumn("edge_share", F.col("edge_trips") / F.col("edge_total"))


def with_lookup_bin(edges: DataFrame, slice_hours: int | None = 6, edge_lookup: str = "row") -> DataFrame:
    """The bin in which an edge looks up its destination.

    ``row``: the bin of the origin's next edge in (bin, destination) order. ``next_bin``: the
    origin's next observed bin.
    """
    part = ["zone_id", slice_of(F.col("bin_local_epoch"), slice_hours)]
    if edge_lookup == "row":
        w = Window.partitionBy(*part).orderBy("bin_local_epoch", "drop_zone_id")
        return edges.withColumn("lookup_bin", F.lead("bin_local_epoch").over(w))
    if edge_lookup != "next_bin":
        raise ValueError(f"unknown edge_lookup: {edge_lookup}")
    later = Window.partitionBy(*part).orderBy("bin_local_epoch").rangeBetween(1, Window.unboundedFollowing)
    return edges.withColumn("lookup_bin", F.min("bin_local_epoch").over(later))


def downstream_value(edges: DataFrame, zone_bins: DataFrame, slice_hours: int | None = 6,
                     edge_lookup: str = "row") -> DataFrame:
    """Share-weighted value of where an origin's trips end, and how many ends were found."""
    d = with_lookup_bin(edges, slice_hours, edge_lookup)
    z = zone_bins.select(
        F.col("zone_id").alias("drop_zone_id"), F.col("bin_local_epoch").alias("lookup_bin"),
        F.col("pickups_now").alias("dest_pickups"), F.col("median_driver_pay").alias("dest_pay"),
        F.col("median_pay_per_min").alias("dest_pay_per_min"),
    )
    value = weighted_average_skip_null([
        (0.50, F.log(1 + F.coalesce("dest_pickups", F.lit(0)))),
        (0.35, F.col("dest_pay")),
        (0.15, F.col("dest_pay_per_min")),
    ])
    joined = d.join(z, ["drop_zone_id", "lookup_bin"], "left")
    found = F.when(F.col("dest_pickups").isNotNull(), F.col("edge_trips")).otherwise(0)
    return joined.groupBy(*KEYS).agg(
        F.round(F.sum(F.col("edge_share") * value), STABLE_DIGITS).alias("downstream_value_raw"),
        (F.sum(found) / F.sum("edge_trips")).alias("downstream_coverage"),
    )


def with_density(df: DataFrame) -> DataFrame:
    area = F.col("zone_area_sq_miles")
    return df.withColumns({
        "pickups_per_sq_mile_now": F.when(area > 0, F.round(F.col("pickups_now") / area, STABLE_DIGITS)),
        "pickups_per_sq_mile_next": F.when(area > 0, F.round(F.col("pickups_next") / area, STABLE_DIGITS)),
    })


def support_strength(min_trips: int) -> Column:
    return clip(F.col("pickups_now") / min_trips)


def with_flows(zone_bins: DataFrame, edges: DataFrame, slice_hours: int | None = 6,
               edge_lookup: str = "row") -> DataFrame:
    flows = downstream_value(edges, zone_bins, slice_hours, edge_lookup)
    joined = zone_bins.join(flows, KEYS, "left")
    return with_density(joined.withColumns({
        "downstream_value_raw": zero_if_null("downstream_value_raw"),
        "downstream_coverage": zero_if_null("downstream_coverage"),
    }))
