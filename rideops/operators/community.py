"""Presence, message threads and operational reads."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideops.functions.columns import lenient_true
from rideops.operators.drivers import active_users, public_name
from rideops.operators.ordered import latest_per_key

FRESH_SECONDS, ACCURACY_METERS = 300, 50.0
PUBLIC_DAYS, PRIVATE_DAYS = 7, 30


def presence_latest(positions: DataFrame, max_accuracy: float = ACCURACY_METERS) -> DataFrame:
    """Last position per user; coarse positions are ignored. A combinable aggregate, no sort."""
    good = positions.filter(F.coalesce(F.col("accuracy") <= max_accuracy, F.lit(True)))
    return latest_per_key(good, "user_id", ["at", "event_id"])


def visibility(now: int, max_age: int = FRESH_SECONDS) -> Column:
    """Why a user is not shown, or null when visible. Needs the user columns (left joined)."""
    return (F.when(F.col("email").isNull(), "account_deleted").when(lenient_true(F.col("is_disabled")), "disabled")
            .when(lenient_true(F.col("is_suspended")), "suspended").when(lenient_true(F.col("ghost_mode")), "ghost_mode")
            .when(F.col("at") < now - max_age, "stale"))


def _with_users(presence: DataFrame, users: DataFrame) -> DataFrame:
    return presence.join(users.select("user_id", "email", "display_name", "is_disabled", "is_suspended", "ghost_mode"), "user_id", "left")


def presence_viewport(presence: DataFrame, users: DataFrame, now: int, box: tuple[float, float, float, float],
                      max_age: int = FRESH_SECONDS, limit: int | None = None) -> DataFrame:
    """Fresh, visible users in (min_lat, min_lng, max_lat, max_lng), newest first."""
    low_lat, low_lng, high_lat, high_lng = box
    near = presence.filter((F.col("at") >= now - max_age) & F.col("lat").between(low_lat, high_lat) & F.col("lng").between(low_lng, high_lng))
    shown = _with_users(near, users).filter(visibility(now, max_age).isNull()).select("user_id", public_name().alias("display_name"), "lat", "lng", "at")
    return shown if limit is None else shown.orderBy(F.desc("at"), "user_id").limit(limit)


def presence_delta(presence: DataFrame, users: DataFrame, now: int, since_ms: int, max_age: int = FRESH_SECONDS) -> DataFrame:
    """Rows changed after a millisecond cursor, as items or removals with a reason."""
    changed = presence.withColumn("changed_at_ms", F.col("at") * 1000).filter(F.col("changed_at_ms") > since_ms)
    reason = visibility(now, max_age)
    cursor = F.greatest(F.coalesce(changed.agg(F.max("changed_at_ms")).scalar(), F.lit(since_ms)), F.lit(since_ms))
    return _with_users(changed, users).select(
        "user_id", F.when(reason.isNull(), "item").otherwise("removed").alias("kind"), reason.alias("reason"), "changed_at_ms",
        cursor.alias("cursor"))


def presence_counts(presence: DataFrame, users: DataFrame, now: int, max_age: int = FRESH_SECONDS) -> DataFrame:
    fresh = _with_users(presence.filter(F.col("at") >= now - max_age), users)
    return fresh.agg(F.count("*").alias("online"), F.count_if(lenient_true(F.col("ghost_mode"))).alias("ghosted"),
                     F.count_if(visibility(now, max_age).isNull()).alias("visible"))


def live_drivers(presence: DataFrame, users: DataFrame, badges: DataFrame, limit: int = 1000) -> DataFrame:
    newest = presence.orderBy(F.desc("at"), "user_id").limit(limit)
    return _with_users(newest, users).join(badges.select("user_id", "badge_code"), "user_id", "left").select(
        "user_id", "display_name", "lat", "lng", "at", F.coalesce("ghost_mode", F.lit(False)).alias("ghost_mode"), "badge_code")


def _from_active(messages: DataFrame, users: DataFrame, sender: str = "user_id") -> DataFrame:
    return messages.join(active_users(users).select(F.col("user_id").alias(sender)), sender, "left_semi")


def parse_cursor(after: str | None) -> tuple[str, int] | None:
    """A message id (digits) or an ISO time, UTC if it names no offset; nothing without a text."""
    text = (after or "").strip()
    if not text:
        return None
    if text.isdigit():
        return "message_id", int(text)
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError("a cursor is a message id or an ISO time") from None
    return "created_at", int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp())


def room_messages(messages: DataFrame, users: DataFrame, room: str, limit: int, after: str | None = None) -> DataFrame:
    """The newest messages of a room, or the first ones after a cursor; oldest first either way.

    Between 1 and 200 messages; those of blocked users do not count.
    """
    room, cursor, limit = room.strip(), parse_cursor(after), max(1, min(200, limit))
    if not room:
        raise ValueError("a room is required")
    kept = _from_active(messages.filter(F.col("room") == room), users)
    if cursor is not None:
        field, value = cursor
        return kept.filter(F.col(field) > value).orderBy("message_id").limit(limit)
    return kept.orderBy(F.desc("message_id")).limit(limit).orderBy("message_id")


def newest_per_room(messages: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """The newest ``k`` messages of every room; Spark cuts the top k before the shuffle."""
    newest = Window.partitionBy("room").orderBy(F.desc("message_id"))
    return _from_active(messages, users).withColumn("age_rank", F.row_number().over(newest)).filter(F.col("age_rank") <= k)


def room_summary(messages: DataFrame, users: DataFrame, after_id: int | None = None) -> DataFrame:
    """Latest message and number of messages after a cursor, per room."""
    newer = F.lit(True) if after_id is None else F.col("message_id") > after_id
    latest = F.max_by(F.struct("message_id", "user_id", "created_at", "message_type"), "message_id")
    out = _from_active(messages, users).groupBy("room").agg(latest.alias("m"), F.count_if(newer).alias("unread_count"))
    return out.select("room", F.col("m.message_id").alias("latest_message_id"), F.col("m.user_id").alias("latest_user_id"),
                      F.col("m.created_at").alias("latest_created_at"), "unread_count", (F.col("unread_count") > 0).alias("has_newer"))


def preview(text: Column, message_type: Column) -> Column:
    clean = F.trim(F.coalesce(text, F.lit("")))
    return F.when(clean != "", clean).when(message_type == "voice", "[Voice note]").otherwise("")


def dm_threads(messages: DataFrame, users: DataFrame) -> DataFrame:
    """One row per user and counterpart: last message, preview and unread count.

    Each message counts for both sides; one combinable aggregation yields last message and
    unread together. Threads with a counterpart that no longer exists are dropped.
    """
    sides = F.array(
        F.struct(F.col("sender_id").alias("user_id"), F.col("recipient_id").alias("other_id"), F.lit(0).alias("unread")),
        F.struct(F.col("recipient_id").alias("user_id"), F.col("sender_id").alias("other_id"), F.col("read_at").isNull().cast("int").alias("unread")))
    rows = messages.select("message_id", "sender_id", "text", "created_at", "message_type", F.explode(sides).alias("s")).select(
        "message_id", "sender_id", "text", "created_at", "message_type", "s.*")
    threads = rows.groupBy("user_id", "other_id").agg(
        F.max_by(F.struct("message_id", "sender_id", "created_at", preview(F.col("text"), F.col("message_type")).alias("preview")), "message_id").alias("m"),
        F.sum("unread").alias("unread_count")).select("user_id", "other_id", "m.*", "unread_count")
    names = users.select(F.col("user_id").alias("other_id"), public_name().alias("other_name"))
    return threads.join(names, "other_id")


def dm_conversation(messages: DataFrame, me: int, other: int, limit: int, since_id: int | None = None) -> DataFrame:
    """Messages of a pair, newest page first shown in order, or those after an id."""
    pair = (F.least("sender_id", "recipient_id") == min(me, other)) & (F.greatest("sender_id", "recipient_id") == max(me, other))
    kept = messages.filter(pair)
    if since_id is not None:
        return kept.filter(F.col("message_id") > since_id).orderBy("created_at", "message_id").limit(limit)
    return kept.orderBy(F.desc("created_at"), F.desc("message_id")).limit(limit).orderBy("created_at", "message_id")


def inbox_summary(threads: DataFrame) -> DataFrame:
    return threads.groupBy("user_id").agg(F.count("*").alias("thread_count"), F.sum("unread_count").alias("total_unread"))


def media_messages(messages: DataFrame, users: DataFrame, room: str, limit: int, before_id: int | None = None) -> DataFrame:
    """Newest images of a room before an id; one row more than the page tells whether there are more."""
    kept = messages.filter((F.col("room") == room) & (F.col("message_type") == "image") & F.col("image_path").isNotNull())
    if before_id is not None:
        kept = kept.filter(F.col("message_id") < before_id)
    page = _from_active(kept, users).orderBy(F.desc("message_id")).limit(limit + 1)
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("message_id"))
    rows = page.withColumn("n", F.row_number().over(w))
    return rows.withColumn("has_more", F.max("n").over(Window.partitionBy(F.lit(1))) > limit).filter(F.col("n") <= limit).drop("n")


def chat_retention(public: DataFrame, private: DataFrame, now: int) -> DataFrame:
    """Expired messages of both kinds with the media paths to remove."""
    def expired(df: DataFrame, scope: str, days: int) -> DataFrame:
        return df.filter(F.col("created_at") < now - days * 86400).select(F.lit(scope).alias("scope"), "message_id", "audio_path", "image_path")

    return expired(public, "public", PUBLIC_DAYS).unionByName(expired(private, "private", PRIVATE_DAYS))


def expired_media(expired: DataFrame) -> DataFrame:
    return expired.select(F.explode(F.array_compact(F.array("audio_path", "image_path"))).alias("path")).distinct()


def user_search(users: DataFrame, me: int, text: str, limit: int, offset: int = 0) -> DataFrame:
    """Active users other than oneself whose name or e-mail contains the text, paged."""
    needle = F.lit(text.strip().lower())
    name, email = F.lower(F.coalesce("display_name", F.lit(""))), F.lower(F.coalesce("email", F.lit("")))
    hit = active_users(users).filter((F.col("user_id") != me) & (name.contains(needle) | email.contains(needle)))
    return hit.orderBy(F.lower(F.coalesce("display_name", "email")), "user_id").offset(offset).limit(limit).select(
        "user_id", public_name().alias("display_name"), "email")


def police_reports(reports: DataFrame, limit: int) -> DataFrame:
    return reports.filter(F.lower("type") == "police").orderBy(F.desc("created_at"), F.desc("report_id")).limit(limit)


def recent_report_count(reports: DataFrame, now: int, window_seconds: int = 86400) -> DataFrame:
    kept = (F.lower("type") == "police") & (F.col("created_at") >= now - window_seconds)
    return reports.agg(F.count_if(kept).alias("police_reports"))


def admin_summary(users: DataFrame, presence: DataFrame, reports: DataFrame, pickups: DataFrame, now: int) -> DataFrame:
    """One row of totals. Every part is a one-row aggregate used as a scalar, not a join."""
    day = now - 86400
    counts = presence_counts(presence, users, now)
    recent = pickups.filter(F.col("created_at") >= day)
    voided = F.coalesce("is_voided", F.lit(False))
    return users.agg(F.count("*").alias("total_users"), F.count_if(lenient_true(F.col("is_admin"))).alias("admin_users")).withColumns({
        "online_users": counts.select("online").scalar(), "ghosted_online_users": counts.select("ghosted").scalar(),
        "police_reports_24h": recent_report_count(reports, now).scalar(),
        "pickups_24h": recent.agg(F.count_if(~voided)).scalar(), "voided_pickups_24h": recent.agg(F.count_if(voided)).scalar()})


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def user_detail(users: DataFrame, presence: DataFrame, pickups: DataFrame, reports: DataFrame) -> DataFrame:
    """Profile with position and counts; the fact tables are reduced per user before the joins."""
    voided = F.coalesce("is_voided", F.lit(False))
    p = pickups.groupBy("user_id").agg(F.count_if(~voided).alias("pickup_count"), F.count_if(voided).alias("voided_pickup_count"))
    r = reports.filter(F.lower("type") == "police").groupBy("user_id").agg(F.count("*").alias("police_report_count"))
    at = presence.select("user_id", "lat", "lng", F.col("at").alias("last_seen_at"))
    return users.join(at, "user_id", "left").join(p, "user_id", "left").join(r, "user_id", "left").fillna(
        0, ["pickup_count", "voided_pickup_count", "police_report_count"])


def account_purge(tables: dict[str, tuple[DataFrame, list[str]]], anonymize: dict[str, tuple[DataFrame, str]], media: dict[str, list[str]],
                  leaving: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Remove accounts: remaining rows per table, what was deleted or anonymised, and files to delete.

    ``tables`` gives the user columns of each; a row goes when any of them is leaving. Rows of
    ``anonymize`` stay, without the user. ``media`` names columns of the tables that hold paths:
    the third result has each path of a deleted row once. Remaining rows come from one pass with
    anti-joins; a count reads only the user columns.
    """
    leaving = leaving.select(F.col("user_id").alias("_leaving")).distinct()

    def going(df: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
        return df.join(leaving, F.col(column) == F.col("_leaving"), how)

    def split(df: DataFrame, columns: list[str]) -> list[DataFrame]:
        """The rows that go, apart by the first column that is leaving."""
        parts, rest = [], df
        for c in columns:
            parts.append(going(rest, c))
            rest = going(rest, c, "left_anti")
        return [*parts, rest]

    remaining, counts, files = {}, [], []
    for name, (df, columns) in tables.items():
        *parts, remaining[name] = split(df, columns)
        gone = reduce(DataFrame.unionByName, split(df.select(*columns), columns)[:-1])
        counts.append(gone.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), F.lit("deleted").alias("what"), "rows"))
        if media.get(name):
            paths = F.array_distinct(F.array_compact(F.array(*[F.nullif(F.trim(c), F.lit("")) for c in media[name]])))
            files += [p.select(F.explode(paths).alias("path")) for p in parts]
    for name, (df, column) in anonymize.items():
        gone = going(df.select(column), column)
        counts.append(gone.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), F.lit("anonymized").alias("what"), "rows"))
        hit = df.join(leaving, F.col(column) == F.col("_leaving"), "left")
        remaining[name] = hit.withColumn(column, F.when(F.col("_leaving").isNull(), F.col(column))).select(*df.columns)
    paths = reduce(DataFrame.unionByName, files).distinct() if files else leaving.select(F.lit("").alias("path")).limit(0)
    return remaining, reduce(DataFrame.unionByName, counts), paths
