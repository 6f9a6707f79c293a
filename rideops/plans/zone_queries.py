"""Registered queries of the trip, zone-bin, rank and score families."""

from __future__ import annotations

from pyspark.sql import functions as F

from rideops.functions.columns import rounded, weighted_average_skip_null
from rideops.operators import ranks, scoring, trip_features as tf, zone_bins as zb
from rideops.plans import common
from rideops.plans.common import r6
from rideops.plans.scored import zone_bin_facts, zone_bin_scored
from rideops.sources import adapters
from rideops.sources.trips import normalize_trips

KEY = ("zone_id", "bin_local_epoch")
FEATURES = {
    "busy_base": (scoring.with_busy_base, "demand_support_n density_support_n effective_density_now_n effective_density_next_n busy_now_n busy_next_n"),
    "saturation_pressure": (lambda d: scoring.with_saturation(scoring.with_busy_base(d)), "market_pressure_n borough_multiplier market_saturation_n"),
    "churn_pressure": (scoring.with_churn, "churn_pressure_n"),
    "core_guard_features": (lambda d: scoring.with_core_features(scoring.with_churn(scoring.with_busy_base(d))), "core_saturation_n core_discount core_trap_n core_escape_n"),
    "return_risk_escape_quality": (scoring.with_risk_and_escape, "return_risk escape_quality"),
}


def _ranked(spark, sf):
    return ranks.with_ranks(common.joined(spark, sf))


def _rank_query(names):
    def run(spark, sf):
        return _ranked(spark, sf).select(*KEY, *r6(*names))
    return run


def _feature_query(build, names):
    def run(spark, sf):
        return build(_ranked(spark, sf)).select(*KEY, *r6(*names.split()))
    return run


def _raw(spark, sf):
    return scoring.with_raw_scores(scoring.with_features(_ranked(spark, sf)))


def trips_scan(spark, sf):
    t = normalize_trips(adapters.trips(spark, sf), "2025-01-07 00:00:00", "2025-01-10 00:00:00")
    return t.groupBy("zone_id", F.coalesce("drop_zone_id", F.lit(-1)).alias("drop_zone_id")).agg(
        F.count("*").alias("trips"), F.sum(F.floor(F.col("driver_pay") * 100 + 0.5)).alias("pay_cents"),
        F.sum(F.col("trip_time").cast("long")).alias("seconds"),
        F.min(F.unix_timestamp("pickup_datetime")).alias("first_pickup"),
        F.max(F.unix_timestamp("pickup_datetime")).alias("last_pickup"))


def trip_local_time(spark, sf):
    return common.prepared(spark, sf).groupBy(
        "zone_id", F.unix_timestamp("pickup_datetime").alias("pickup_epoch"), "local_epoch").agg(F.count("*").alias("trips"))


def trip_rates(spark, sf):
    return common.prepared(spark, sf).select(
        "zone_id", F.unix_timestamp("pickup_datetime").alias("pickup_epoch"),
        F.unix_timestamp("request_datetime").alias("request_epoch"), "trip_time",
        *r6("driver_pay", "trip_miles", "request_min", "pay_per_min", "pay_per_mile"))


def trip_bin(spark, sf):
    bins = common.prepared(spark, sf).groupBy("bin_local_epoch").agg(F.count("*").alias("trips"))
    return tf.bin_labels(bins).withColumn("bin_date", F.col("bin_date").cast("string"))


def _flag_query(names):
    def run(spark, sf):
        return common.prepared(spark, sf).groupBy(*KEY, *names).agg(F.count("*").alias("trips"))
    return run


def shared_flag_coalesce(spark, sf):
    return common.trips(spark, sf).groupBy("zone_id", "shared_flag").agg(F.count("*").alias("trips"))


def zone_bin_agg(spark, sf):
    return zb.zone_bin_agg(common.prepared(spark, sf)).select(*KEY, "pickups_now", *r6(*zb.MEDIANS, *zb.SHARES))


def zone_bin_grid(spark, sf):
    grid = zb.zone_bin_grid(common.prepared(spark, sf), common.zones(spark, sf))
    return grid.select("zone_id", "zone_name", "borough_name", *r6("zone_area_sq_miles"), "bin_local_epoch")


def zone_bin_filled(spark, sf):
    return zone_bin_facts(common.trips(spark, sf), common.zones(spark, sf)).select(
        *KEY, "pickups_now", "pickups_next", *r6(*zb.MEDIANS, *zb.SHARES))


def next_bin_pickups(spark, sf):
    return zb.next_bin_pickups(zb.zone_bin_agg(common.prepared(spark, sf))).select(*KEY, "pickups_now", "pickups_next")


def od_edges(spark, sf):
    edges = zb.with_lookup_bin(zb.od_edges(zb.od_counts(common.prepared(spark, sf))))
    return edges.select("zone_id", "drop_zone_id", "bin_local_epoch", "edge_trips", "edge_total", *r6("edge_share"), "lookup_bin")


def downstream_value(spark, sf):
    edges = zb.od_edges(zb.od_counts(common.prepared(spark, sf)))
    return zb.downstream_value(edges, zone_bin_facts(common.trips(spark, sf), common.zones(spark, sf))).select(*KEY, *r6("downstream_value_raw", "downstream_coverage"))


def pickup_density(spark, sf):
    return common.joined(spark, sf).select(*KEY, *r6("pickups_per_sq_mile_now", "pickups_per_sq_mile_next"))


def support_strength(spark, sf):
    return common.joined(spark, sf).select(*KEY, rounded(zb.support_strength(scoring.MIN_TRIPS)).alias("support_strength"))


def null_weighted_average(spark, sf):
    pay = weighted_average_skip_null([
        (0.35, F.col("median_driver_pay")), (0.15, F.col("median_pay_per_min")), (0.10, F.col("median_pay_per_mile"))])
    return common.joined(spark, sf).select(*KEY, rounded(pay).alias("pay_quality"))


def profile_score_v2(spark, sf):
    return _raw(spark, sf).select(*KEY, *r6(*[f"raw_{p}" for p in scoring.V2_WEIGHTS]))


def profile_score_v3(spark, sf):
    return _raw(spark, sf).select(*KEY, *r6(*[f"raw_{p}" for p in scoring.V3_WEIGHTS if p != "citywide_v3"]))


def citywide_tiered_score(spark, sf):
    return _raw(spark, sf).select(*KEY, "citywide_pre_tier_rating", *r6(
        "citywide_pre_tier_raw", "citywide_balanced_weight", "citywide_long_weight", "citywide_saturation_weight", "raw_citywide_v3"))


def profile_confidence(spark, sf):
    names = (*scoring.V2_WEIGHTS, *scoring.V3_WEIGHTS)
    return scoring.with_confidence(_raw(spark, sf), common.TEST_MIN_TRIPS).select(
        *KEY, *r6(*[f"confidence_{p}" for p in names], *[f"score_{p}" for p in names]))


def trap_candidate_score(spark, sf):
    names = [n for p in scoring.V3_WEIGHTS for n in (f"score_{p}_candidate", f"confidence_{p}_candidate", f"delta_{p}")]
    return scoring.with_trap_candidates(scoring.with_confidence(_raw(spark, sf), common.TEST_MIN_TRIPS)).select(*KEY, *r6(*names))


def rating_bucket_color(spark, sf):
    names = [n for f in scoring.FAMILIES for n in (f"rating_{f}", f"bucket_{f}", f"color_{f}")]
    return common.scored(spark, sf).select(*KEY, *names)


def score_components(spark, sf):
    out = scoring.score_components(_raw(spark, sf))
    return out.select(*KEY, *r6(*[c for c in out.columns if c not in KEY]))


def flagship(spark, sf):
    """Trips to scored zone-bins, nothing shared with other queries."""
    out = zone_bin_scored(common.trips(spark, sf), common.zones(spark, sf), min_trips=common.TEST_MIN_TRIPS)
    return out.select(
        "zone_id", "zone_name", "borough_name", "bin_local_epoch", "pickups_now", "pickups_next",
        *r6(*zb.MEDIANS, *zb.SHARES, "downstream_value_raw", "downstream_coverage", "return_risk", "escape_quality",
            *[f"score_{f}" for f in scoring.FAMILIES], *[f"confidence_{f}" for f in scoring.FAMILIES]),
        *[f"rating_{f}" for f in scoring.FAMILIES])


QUERIES = {
    "trips_scan": trips_scan,
    "trip_local_time": trip_local_time,
    "trip_rates": trip_rates,
    "trip_bin": trip_bin,
    "trip_flags": _flag_query(["is_short", "is_shared", "is_long", "is_balanced", "is_same_zone"]),
    "trip_exit_flags": _flag_query(["is_airport_exit", "is_network_drop", "is_out_of_network", "is_short_external_6mi",
                                    "is_short_external_8mi", "is_long_external"]),
    "airport_zone_flag": lambda s, sf: common.zones(s, sf).select("zone_id", "zone_name", "borough_name", "airport_excluded"),
    "shared_flag_coalesce": shared_flag_coalesce,
    "zone_bin_agg": zone_bin_agg,
    "zone_bin_grid": zone_bin_grid,
    "zone_bin_filled": zone_bin_filled,
    "next_bin_pickups": next_bin_pickups,
    "od_edges": od_edges,
    "downstream_value": downstream_value,
    "pickup_density": pickup_density,
    "support_strength": support_strength,
    "percentile_rank_in_bin": _rank_query(list(ranks.ALL_ROWS)),
    "percentile_rank_nullable": _rank_query(list(ranks.NON_NULL)),
    "percentile_rank_share": _rank_query(list(ranks.SHARE)),
    "demand_zero_guard": lambda s, sf: _ranked(s, sf).select(*KEY, "pickups_now", "pickups_next", *r6(*ranks.DEMAND)),
    "null_weighted_average": null_weighted_average,
    **{k: _feature_query(b, n) for k, (b, n) in FEATURES.items()},
    "profile_score_v2": profile_score_v2,
    "profile_score_v3": profile_score_v3,
    "citywide_tiered_score": citywide_tiered_score,
    "profile_confidence": profile_confidence,
    "trap_candidate_score": trap_candidate_score,
    "rating_bucket_color": rating_bucket_color,
    "score_components": score_components,
    "zone_bin_scored": flagship,
}
