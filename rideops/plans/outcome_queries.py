"""Registered queries of the outcome, guard, trip report and guidance families."""

from __future__ import annotations

from pyspark.sql import functions as F

from rideops.operators import drivers as d, guidance as g, outcomes as o
from rideops.operators.ordered import latest_per_key
from rideops.plans import common
from rideops.plans.common import r6
from rideops.sources import adapters as a

SINCE = 4 * 3600
ASKED_ZONES = [119, 120, 131, 999, 120]


def _micro(spark, sf):
    return a.resolved_outcomes(spark, sf)


def settle_hotspot_outcomes(spark, sf):
    out = o.settle_hotspot_outcomes(a.recommendations(spark, sf), a.pickups(spark, sf))
    return out.select("user_id", "zone_id", "pickup_id", "recommendation_id", "settled_at", *r6("minutes_to_trip", "distance_miles"), "spatial")


def settle_micro_outcomes(spark, sf):
    out = o.settle_micro_outcomes(a.recommendations(spark, sf), a.pickups(spark, sf))
    return out.select("user_id", "zone_id", "pickup_id", "recommendation_id", "settled_at", *r6("minutes_to_trip", "distance_miles"))


def _settled_guidance(spark, sf):
    return o.settle_guidance_outcomes(a.guidance(spark, sf), a.pickups(spark, sf))


def settle_guidance_outcomes(spark, sf):
    return _settled_guidance(spark, sf).withColumn("minutes_to_trip", r6("minutes_to_trip")[0])


def outcome_modifier(spark, sf):
    resolved = a.resolved_outcomes(spark, sf).filter(F.col("converted_to_trip").isNotNull())
    out = o.outcome_modifier(resolved, ["zone_id"], a.NOW)
    return out.select("zone_id", "sample_count", *r6(*[c for c in out.columns if c not in ("zone_id", "sample_count")]))


def experiment_summary(spark, sf):
    bins, outcomes = a.experiment_bins(spark, sf), a.resolved_outcomes(spark, sf)
    out = o.experiment_summary(bins, bins, outcomes, _micro(spark, sf), a.NOW - SINCE)
    means = ("avg_final_score", "avg_confidence", "avg_minutes_converted", "avg_miles_converted", "conversion_rate")
    return out.select(*[c for c in out.columns if c not in means], *r6(*means))


def _ranking(keys):
    def run(spark, sf):
        out = o.conversion_ranking(a.resolved_outcomes(spark, sf), keys, 3, 100)
        means = ("avg_minutes_converted", "avg_miles_converted", "conversion_rate")
        return out.select(*[c for c in out.columns if c not in means], *r6(*means))
    return run


def outcome_listing(spark, sf):
    out = o.outcome_listing(a.resolved_outcomes(spark, sf), a.NOW, 200, status="not_converted", since_seconds=SINCE)
    return out.select("recommendation_id", "user_id", "zone_id", "cluster_id", "recommended_at", "outcome_status", *r6("score", "confidence"))


def experiment_bin_listing(spark, sf):
    out = o.experiment_bin_listing(a.experiment_bins(spark, sf), a.NOW, 200, recommended=True, since_seconds=SINCE)
    return out.select("bin_id", "bin_time", "zone_id", "cluster_id", "recommended", *r6("final_score", "confidence"))


def retention_prune(spark, sf):
    aged = a.resolved_outcomes(spark, sf).withColumn("recommended_at", F.col("recommended_at") - F.col("recommendation_id") % 28 * 86400)
    return o.retention_prune(aged, "recommended_at", a.NOW).groupBy("zone_id").agg(
        F.count("*").alias("kept"), F.min("recommended_at").alias("oldest"))


def pickup_guard_state(spark, sf):
    states = g.guard_states(a.heartbeats(spark, sf))
    return states.select("user_id", F.col("at").alias("seen_at"), "event_id", F.col("session_end.prev_at").alias("previous_session_end_at"),
                         "movement_streak_started_at", "last_meaningful_motion_at")


def pickup_guard_decision(spark, sf):
    decided = g.pickup_guard(a.heartbeats(spark, sf), a.pickups(spark, sf)).filter(F.col("kind") == 1)
    return decided.select("user_id", "event_id", F.col("at").alias("tried_at"), "decision", "ok")


def void_reversal(spark, sf):
    return g.void_reversal(a.pickups(spark, sf)).withColumn("nyc_date", F.col("nyc_date").cast("string"))


def recent_trips(spark, sf):
    out = g.recent_trips(a.pickups(spark, sf), a.users(spark, sf), 100)
    return out.select("pickup_id", "user_id", "display_name", "zone_id", "created_at", "is_voided", "voided_at", "void_reason", *r6("lat", "lng"))


def _latest(spark, sf):
    beats = a.heartbeats(spark, sf)
    return latest_per_key(beats, "user_id", ["at", "event_id"])


def activity_snapshot(spark, sf):
    advice = a.guidance(spark, sf).join(
        _settled_guidance(spark, sf).select("guidance_id", F.lit(True).alias("converted_to_trip")), "guidance_id", "left")
    outcomes = a.resolved_outcomes(spark, sf)
    return g.activity_snapshot(_latest(spark, sf), g.guard_states(a.heartbeats(spark, sf)), a.pickups(spark, sf), outcomes, outcomes, advice, a.guidance_states(spark, sf), a.NOW)


def guidance_action(spark, sf):
    out = g.guidance_action(a.guidance_inputs(spark, sf), a.NOW)
    return out.select("event_id", "user_id", "action", "confidence", "hold_until", "move_cooldown_until",
                      F.array_join("reason_codes", ",").alias("reason_codes"))


def nearby_better_zone(spark, sf):
    scored = common.scored(spark, sf)
    last = scored.agg(F.max("bin_local_epoch")).scalar()
    ratings = scored.filter(F.col("bin_local_epoch") == last).select("zone_id", F.col("rating_citywide_v3").alias("rating"))
    placed = ratings.join(a.zones(spark, sf).select("zone_id", "centroid_latitude", "centroid_longitude"), "zone_id")
    return g.nearby_better_zone(_latest(spark, sf), placed)


def pickup_xp_delta(spark, sf):
    work = d.driver_daily_stats(a.heartbeats(spark, sf)).select("user_id", (d.daily_xp()["miles_xp"] + d.daily_xp()["hours_xp"]).alias("xp"))
    total = work.groupBy("user_id").agg(F.sum("xp").alias("work_xp"))
    out = g.pickup_xp_delta(a.pickups(spark, sf), total)
    return out.select("pickup_id", "user_id", "xp_before", "xp_after", "xp_awarded", "level_before", "level_after", "leveled_up")


def _flat(outlook):
    point = lambda p: F.concat_ws(":", p.bin_local_epoch.cast("string"), p.tracks.citywide_v3.rating.cast("string"),
                                  p.tracks.citywide_v3.bucket, p.tracks.staten_island_v2.rating.cast("string"))
    return outlook.select("bin_local_epoch", "zone_id", F.size("points").alias("n_points"),
                          F.array_join(F.transform(F.sort_array("points"), point), ",").alias("points"))


def guidance_outlook(spark, sf):
    return _flat(g.guidance_outlook(common.scored(spark, sf)))


def outlook_lookup(spark, sf):
    scored = common.scored(spark, sf)
    first = scored.agg(F.min("bin_local_epoch")).scalar()
    return _flat(g.outlook_lookup(g.guidance_outlook(scored), first, ASKED_ZONES))


QUERIES = {
    "settle_hotspot_outcomes": settle_hotspot_outcomes,
    "settle_micro_outcomes": settle_micro_outcomes,
    "settle_guidance_outcomes": settle_guidance_outcomes,
    "outcome_modifier": outcome_modifier,
    "experiment_summary": experiment_summary,
    "zone_conversion_ranking": _ranking(["zone_id"]),
    "micro_conversion_ranking": _ranking(["cluster_id", "zone_id"]),
    "outcome_listing": outcome_listing,
    "experiment_bin_listing": experiment_bin_listing,
    "retention_prune": retention_prune,
    "pickup_guard_state": pickup_guard_state,
    "pickup_guard_decision": pickup_guard_decision,
    "trips_summary": lambda s, sf: g.trips_summary(a.pickups(s, sf), a.NOW),
    "recent_trips": recent_trips,
    "void_reversal": void_reversal,
    "activity_snapshot": activity_snapshot,
    "guidance_action": guidance_action,
    "nearby_better_zone": nearby_better_zone,
    "pickup_xp_delta": pickup_xp_delta,
    "guidance_outlook": guidance_outlook,
    "outlook_lookup": outlook_lookup,
}
