"""Registered queries of the driver, leaderboard, battle and game families."""

from __future__ import annotations

from pyspark.sql import functions as F

from rideops.functions import times
from rideops.operators import battles as b, drivers as d
from rideops.operators.ordered import latest_per_key
from rideops.plans.common import r6
from rideops.sources import adapters as a

TODAY_TEXT = "2025-06-18"
BOARD = ("user_id", "display_name", "metric_value", "rank_position", "period_key", "badge_code")


def _today():
    return F.lit(TODAY_TEXT).cast("date")


def business_date(spark, sf):
    beats = a.heartbeats(spark, sf).groupBy(times.business_date(F.col("at")).cast("string").alias("nyc_date"))
    return beats.agg(F.count("*").alias("heartbeats"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def heartbeat_segments(spark, sf):
    return d.heartbeat_segments(a.heartbeats(spark, sf)).select(
        "event_id", "user_id", "gap_seconds", *r6("miles", "mph", "counted_miles"), "counted_seconds")


def split_by_business_day(spark, sf):
    split = d.split_by_business_day(d.heartbeat_segments(a.heartbeats(spark, sf)))
    return split.select("event_id", "user_id", F.col("nyc_date").cast("string").alias("nyc_date"), "seconds", *r6("split_miles"))


def driver_daily_stats(spark, sf):
    stats = d.driver_daily_stats(a.heartbeats(spark, sf), a.pickups(spark, sf).filter(~F.col("is_voided")))
    return stats.select("user_id", F.col("nyc_date").cast("string").alias("nyc_date"), *r6("miles_worked", "hours_worked"),
                        "heartbeat_count", "trips_recorded", "pickups_recorded")


def period_bounds(spark, sf):
    days = a.daily_stats(spark, sf).groupBy("nyc_date").agg(F.count("*").alias("driver_days"))
    out = []
    for p in d.PERIODS:
        start, end, key = d.period_bounds(F.col("nyc_date"), p)
        out += [start.cast("string").alias(f"{p}_start"), end.cast("string").alias(f"{p}_end"), key.alias(f"{p}_key")]
    return days.select(F.col("nyc_date").cast("string").alias("nyc_date"), "driver_days", *out)


def leaderboard(spark, sf):
    """Every rank of the year; the podium badge comes from the rank."""
    return d.leaderboard(a.daily_stats(spark, sf), a.drivers(spark, sf), "miles_worked", "yearly", _today(), None).select(*BOARD)


def leaderboard_top(spark, sf):
    return d.leaderboard(a.daily_stats(spark, sf), a.drivers(spark, sf), "hours_worked", "monthly", _today(), 100).select(*BOARD)


def my_rank(spark, sf):
    return d.my_rank(a.daily_stats(spark, sf), a.drivers(spark, sf), 42, "miles_worked", "yearly", _today()).select(*BOARD)


def current_badges(spark, sf):
    return d.current_badges(a.daily_stats(spark, sf), a.drivers(spark, sf), _today())


def level_thresholds(spark, sf):
    """The level table with the number of drivers at each level."""
    reached = d.progression(a.daily_stats(spark, sf)).groupBy("level").agg(F.count("*").alias("drivers"))
    return d.level_thresholds(spark).join(reached, "level", "left").withColumn("drivers", F.coalesce("drivers", F.lit(0)))


def progression(spark, sf):
    return d.progression(a.daily_stats(spark, sf), b.game_xp(a.matches(spark, sf)))


def _sent(spark, sf):
    return a.drivers(spark, sf).filter(F.col("user_id") % 4 == 0).select(
        "user_id", F.lit("monthly").alias("report_type"), F.lit("2025-05").alias("period_key"))


def period_report(spark, sf):
    user = F.col("user_id")
    users = a.drivers(spark, sf).withColumn("email", F.when(user % 29 == 0, " ").when(user % 31 != 0, F.col("email")))
    preferences = users.filter(user % 7 != 0).select("user_id", (user % 3 != 1).alias("monthly_enabled"), F.lit(True).alias("weekly_enabled"))
    return d.period_report(a.daily_stats(spark, sf), users, _sent(spark, sf), _today(), "monthly", preferences).select(
        "user_id", "email", "display_name", "miles", "hours", "pickups", "miles_rank", "hours_rank", "period_key", "badge_code")


def _settled(spark, sf):
    return b.battle_settlement(a.battles(spark, sf), a.daily_stats(spark, sf), a.NOW)


def battle_settlement(spark, sf):
    return _settled(spark, sf).select("battle_id", "challenger_value", "challenged_value", "winner_id", "loser_id", "result_code", "status", "completed_at")


def battle_standings(spark, sf):
    return b.battle_standings(a.battles(spark, sf), a.daily_stats(spark, sf), _today()).select(
        "battle_id", "challenger_value", "challenged_value", "leader_id")


def battle_conflicts(spark, sf):
    battles = a.battles(spark, sf)
    return b.battle_conflicts(battles.filter(F.col("status") == "declined"), battles)


def expire_pending(spark, sf):
    return b.expire_pending(a.battles(spark, sf), a.NOW).groupBy("status", "metric").agg(
        F.count("*").alias("battles"), F.min("expires_at").alias("first_expiry"))


def user_cards(spark, sf):
    presence = latest_per_key(a.heartbeats(spark, sf).select("user_id", "at", "event_id"), "user_id", ["at", "event_id"])
    users = a.users(spark, sf)
    stats = a.daily_stats(spark, sf)
    badges = d.current_badges(stats, users, _today())
    return b.user_cards(users, presence, d.progression(stats), badges, a.NOW)


QUERIES = {
    "business_date": business_date,
    "heartbeat_segments": heartbeat_segments,
    "split_by_business_day": split_by_business_day,
    "driver_daily_stats": driver_daily_stats,
    "period_bounds": period_bounds,
    "leaderboard": leaderboard,
    "leaderboard_top": leaderboard_top,
    "my_rank": my_rank,
    "current_badges": current_badges,
    "user_overview": lambda s, sf: d.user_overview(a.daily_stats(s, sf), _today()),
    "progression": progression,
    "level_thresholds": level_thresholds,
    "period_report": period_report,
    "battle_settlement": battle_settlement,
    "battle_standings": battle_standings,
    "battle_history": lambda s, sf: b.battle_history(_settled(s, sf)),
    "battle_conflicts": battle_conflicts,
    "expire_pending": expire_pending,
    "game_record": lambda s, sf: b.game_record(a.matches(s, sf)),
    "game_xp": lambda s, sf: b.game_xp(a.matches(s, sf)),
    "user_cards": user_cards,
    "relationship_status": lambda s, sf: b.relationship_status(a.battles(s, sf)),
}
