"""Registered queries of the presence, community and account families."""

from __future__ import annotations

from pyspark.sql import functions as F

from rideops.operators import accounts as ac, community as c, drivers as d, subscriptions
from rideops.plans.common import r6
from rideops.sources import adapters as a

BOX = (40.70, -73.98, 40.72, -73.96)
AGE = 900


def _positions(spark, sf):
    return a.heartbeats(spark, sf).withColumn("accuracy", (F.col("event_id") % 60).cast("double"))


def _presence(spark, sf):
    return c.presence_latest(_positions(spark, sf))


def _users(spark, sf):
    return a.users(spark, sf)


def presence_latest(spark, sf):
    return _presence(spark, sf).select("user_id", "event_id", "at", *r6("lat", "lng")).withColumnRenamed("at", "seen_at")


def presence_viewport(spark, sf):
    out = c.presence_viewport(_presence(spark, sf), _users(spark, sf), a.NOW, BOX, AGE)
    return out.select("user_id", "display_name", F.col("at").alias("seen_at"), *r6("lat", "lng"))


def presence_delta(spark, sf):
    return c.presence_delta(_presence(spark, sf), _users(spark, sf), a.NOW, (a.NOW - 3600) * 1000, AGE)


def live_drivers(spark, sf):
    badges = d.current_badges(a.daily_stats(spark, sf), _users(spark, sf), F.lit("2025-06-18").cast("date"))
    out = c.live_drivers(_presence(spark, sf), _users(spark, sf), badges, 100)
    return out.select("user_id", "display_name", F.col("at").alias("seen_at"), "ghost_mode", "badge_code", *r6("lat", "lng"))


def room_messages(spark, sf):
    """The newest messages of every room, and two reads of a room behind a cursor."""
    messages, users = a.room_messages(spark, sf), _users(spark, sf)
    columns = ["room", "message_id", "user_id", "created_at", "message_type", "message"]
    out = c.newest_per_room(messages, users, 50).select(F.lit("newest").alias("read"), *columns, "age_rank")
    for read, room, limit, after in (("after_id", "global", 500, "60000"), ("after_time", "room1", 40, "2025-01-04T00:05:00Z"), ("tail", "room2", 30, " ")):
        out = out.unionByName(c.room_messages(messages, users, room, limit, after).select(F.lit(read).alias("read"), *columns), allowMissingColumns=True)
    return out


def dm_threads(spark, sf):
    return c.dm_threads(a.private_messages(spark, sf), _users(spark, sf))


def chat_retention(spark, sf):
    return c.chat_retention(a.room_messages(spark, sf), a.private_messages(spark, sf), a.NOW)


def police_reports(spark, sf):
    out = c.police_reports(a.reports(spark, sf), 500)
    return out.select("report_id", "user_id", "zone_id", "created_at", *r6("lat", "lng")).withColumn(
        "reports_24h", c.recent_report_count(a.reports(spark, sf), a.NOW).scalar())


def admin_summary(spark, sf):
    return c.admin_summary(_users(spark, sf), _presence(spark, sf), a.reports(spark, sf), a.pickups(spark, sf), a.NOW)


def table_counts(spark, sf):
    return c.table_counts({"users": _users(spark, sf), "pickups": a.pickups(spark, sf), "reports": a.reports(spark, sf),
                           "room_messages": a.room_messages(spark, sf), "private_messages": a.private_messages(spark, sf),
                           "daily_stats": a.daily_stats(spark, sf), "battles": a.battles(spark, sf)})


def user_detail(spark, sf):
    out = c.user_detail(_users(spark, sf), _presence(spark, sf), a.pickups(spark, sf), a.reports(spark, sf))
    return out.select("user_id", "email", "display_name", "is_admin", "is_disabled", "is_suspended", "ghost_mode", "created_at", "last_seen_at",
                      "pickup_count", "voided_pickup_count", "police_report_count", *r6("lat", "lng"))


def _purged(spark, sf):
    leaving = _users(spark, sf).filter(F.col("user_id") % 11 == 3).select("user_id")
    presence, stats = _presence(spark, sf), a.daily_stats(spark, sf)
    work = a.heartbeats(spark, sf).groupBy("user_id").agg(F.max("at").alias("last_heartbeat_at"))
    tables = {
        "presence": (presence, ["user_id"]), "presence_runtime_state": (presence.select("user_id", F.col("at").alias("changed_at")), ["user_id"]),
        "room_messages": (a.room_messages(spark, sf), ["user_id"]), "private_messages": (a.private_messages(spark, sf), ["sender_id", "recipient_id"]),
        "reports": (a.reports(spark, sf), ["user_id"]), "pickups": (a.pickups(spark, sf), ["user_id"]),
        "pickup_guard_state": (work.withColumnRenamed("last_heartbeat_at", "last_seen_at"), ["user_id"]), "driver_work_state": (work, ["user_id"]),
        "daily_stats": (stats, ["user_id"]), "badges": (d.current_badges(stats, a.drivers(spark, sf), F.lit("2025-06-18").cast("date")), ["user_id"]), "users": (_users(spark, sf), ["user_id"])}
    media = {t: ["audio_path"] for t in ("room_messages", "private_messages")}
    return c.account_purge(tables, {"outcomes": (a.resolved_outcomes(spark, sf), "user_id")}, media, leaving)


def account_purge(spark, sf):
    remaining, counts, _ = _purged(spark, sf)
    return counts.join(c.table_counts(remaining).withColumnRenamed("rows", "remaining"), "table_name")


def purged_media(spark, sf):
    return _purged(spark, sf)[2]


def subscription_state(spark, sf):
    return subscriptions.subscription_state(a.subscription_events(spark, sf), a.drivers(spark, sf))


def campaign_audience(spark, sf):
    users = _users(spark, sf)
    return ac.campaign_audience(users, users.filter(F.col("user_id") % 8 == 0), "grandfathered:")


QUERIES = {
    "presence_latest": presence_latest,
    "presence_viewport": presence_viewport,
    "presence_delta": presence_delta,
    "presence_counts": lambda s, sf: c.presence_counts(_presence(s, sf), _users(s, sf), a.NOW, AGE),
    "live_drivers": live_drivers,
    "active_users": lambda s, sf: d.active_users(_users(s, sf)).select("user_id", "email"),
    "room_messages": room_messages,
    "room_summary": lambda s, sf: c.room_summary(a.room_messages(s, sf), _users(s, sf), 100_000),
    "dm_threads": dm_threads,
    "dm_conversation": lambda s, sf: c.dm_conversation(a.private_messages(s, sf), 1, 8, 100).select("message_id", "sender_id", "recipient_id", "created_at", "text"),
    "inbox_summary": lambda s, sf: c.inbox_summary(dm_threads(s, sf)),
    "media_messages": lambda s, sf: c.media_messages(a.room_messages(s, sf), _users(s, sf), "global", 20, 90_000).select("message_id", "user_id", "image_path", "has_more"),
    "chat_retention": chat_retention,
    "expired_media": lambda s, sf: c.expired_media(chat_retention(s, sf)),
    "user_search": lambda s, sf: c.user_search(_users(s, sf), 2, "er 1", 25, 3),
    "police_reports": police_reports,
    "admin_summary": admin_summary,
    "table_counts": table_counts,
    "user_detail": user_detail,
    "account_purge": account_purge,
    "purged_media": purged_media,
    "subscription_state": subscription_state,
    "access_status": lambda s, sf: ac.access_status(_users(s, sf), a.NOW),
    "active_comps": lambda s, sf: ac.active_comps(_users(s, sf), a.NOW, "r"),
    "campaign_audience": campaign_audience,
}
