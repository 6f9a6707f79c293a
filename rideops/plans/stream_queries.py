"""Registered streaming queries: whole tables replayed through the streaming jobs.

Each runs until its input is used up and writes below the shared scratch folder; the result is
what was emitted, so rows still waiting for the watermark are absent.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rideops.plans.common import r6
from rideops.sources import adapters as a
from rideops.sources.store import scratch_path
from rideops.streaming import jobs


def _run(spark, stream, name):
    return jobs.run_available(stream, scratch_path(spark, name))


def _stateful(spark):
    jobs.require_state_store(spark)


def stream_zone_demand(spark, sf):
    points = a.user_events_stream(spark, sf).filter(F.col("event_type") == "purchase")
    return _run(spark, jobs.zone_demand(points), "zone-demand")


def stream_sessions(spark, sf):
    return _run(spark, jobs.sessions(a.user_events_stream(spark, sf)), "sessions")


def stream_presence(spark, sf):
    _stateful(spark)
    out = _run(spark, jobs.presence(a.user_events_stream(spark, sf)), "presence")
    return out.select("user_id", "kind", F.col("at").alias("seen_at"), *r6("lat", "lng"))


def stream_daily_stats(spark, sf):
    _stateful(spark)
    path = scratch_path(spark, "daily-stats")
    query = (jobs.daily_segments(a.user_events_stream(spark, sf)).writeStream.foreachBatch(jobs.append_daily_stats(f"{path}/out"))
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return jobs.read_daily_stats(spark, f"{path}/out").select(
        "user_id", F.col("nyc_date").cast("string").alias("nyc_date"), *r6("miles_worked", "hours_worked"), "heartbeat_count")


def stream_pickup_guard(spark, sf):
    _stateful(spark)
    e = a.user_events_stream(spark, sf)
    kinds = F.when(F.col("event_type") != "purchase", F.array(F.lit(0))).when(F.col("event_id") % 11 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    events = e.select("user_id", "at", "ts", "event_id", "lat", "lng", F.explode(kinds).alias("kind"))
    # A void arrives half an hour after its attempt.
    events = events.withColumn("at", F.when(F.col("kind") == 2, F.col("at") + 1800).otherwise(F.col("at"))).withColumn("ts", F.timestamp_seconds("at"))
    return _run(spark, jobs.pickup_guard(events), "guard").filter(F.col("kind") == 1).select(
        "user_id", "event_id", F.col("at").alias("tried_at"), "decision", "ok")


def stream_event_dedup(spark, sf):
    _stateful(spark)
    e = a.subscription_events_stream(spark, sf)
    own = F.when(F.col("event_type").startswith("subscription."), F.get_json_object("raw_event_json", "$.data.id"))
    keyed = e.withColumn("user_key", F.coalesce(F.get_json_object("raw_event_json", "$.data.subscription_id"), own, F.lit("none")))
    return _run(spark, jobs.event_dedup(keyed, 30 * 86400), "dedup")


def stream_expiry(spark, sf):
    """Recommendations without a purchase event in the same slot count as pending for half an hour."""
    _stateful(spark)
    e = a.user_events_stream(spark, sf)
    items = e.filter(F.col("event_type").isin("view", "purchase")).select(
        "user_id", F.col("event_id").alias("item_id"), F.lit("created").alias("kind"), "at", "ts")
    answered = e.filter((F.col("event_type") == "view") & (F.col("event_id") % 3 == 0)).select(
        "user_id", F.col("event_id").alias("item_id"), F.lit("responded").alias("kind"), (F.col("at") + 600).alias("at"), F.timestamp_seconds(F.col("at") + 600).alias("ts"))
    return _run(spark, jobs.expiry(items.union(answered), 1800, "10 minutes"), "expiry")


def stream_outcome_settlement(spark, sf):
    _stateful(spark)
    e = a.user_events_stream(spark, sf)
    is_view = F.col("event_type") == "view"
    events = e.filter(F.col("event_type").isin("view", "purchase")).select(
        "user_id", "zone_id", "ts", "at", F.when(is_view, 0).otherwise(1).alias("kind"), "event_id",
        F.when(is_view, F.col("next_lat")).otherwise(F.col("lat")).alias("lat"), F.when(is_view, F.col("next_lng")).otherwise(F.col("lng")).alias("lng"))
    out = _run(spark, jobs.outcome_settlement(events), "settlement")
    return out.select("user_id", "zone_id", "recommendation_id", "recommended_at", "pickup_id", "picked_up_at", *r6("minutes_to_trip", "distance_miles"), "converted_to_trip")


QUERIES = {
    "stream_zone_demand": stream_zone_demand,
    "stream_presence": stream_presence,
    "stream_daily_stats": stream_daily_stats,
    "stream_pickup_guard": stream_pickup_guard,
    "stream_sessions": stream_sessions,
    "stream_event_dedup": stream_event_dedup,
    "stream_expiry": stream_expiry,
    "stream_outcome_settlement": stream_outcome_settlement,
}
