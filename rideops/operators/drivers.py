"""Driver work, leaderboards and progression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rideops.functions import times
from rideops.functions.columns import lenient_true, rounded_even
from rideops.functions.geo import haversine_miles
from rideops.operators.ordered import with_global_rank, with_previous

MAX_COUNTED_GAP = 300
MIN_MILES = 0.01
MIN_MPH, MAX_MPH = 1.0, 100.0
# XP per mile, hour and reported pickup, pickups counted per day, levels.
XP_PER_MILE, XP_PER_HOUR, XP_PER_PICKUP, PICKUPS_PER_DAY = 8, 30, 20, 25
MAX_LEVEL, LEVELS_PER_BAND = 1000, 10
BADGES = ((1, "crown"), (2, "silver"), (3, "bronze"))
PERIODS = ("daily", "weekly", "monthly", "yearly")


def heartbeat_segments(heartbeats: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Gap, distance and speed to the driver's previous heartbeat, and what of it counts.

    Only plausible movement counts (1 to 100 mph, at least 0.01 miles), for at most 300 s.
    """
    rows = with_previous(heartbeats, "user_id", "at", "event_id", ["at", "lat", "lng"], bucket_seconds)
    rows = rows.withColumn("gap_seconds", F.col("at") - F.col("prev_at")).withColumn(
        "miles", haversine_miles(F.col("prev_lat"), F.col("prev_lng"), F.col("lat"), F.col("lng")))
    rows = rows.withColumn("mph", F.when(F.col("gap_seconds") > 0, F.col("miles") / (F.col("gap_seconds") / 3600.0)))
    counted = F.coalesce(F.col("mph").between(MIN_MPH, MAX_MPH) & (F.col("miles") >= MIN_MILES), F.lit(False))
    return rows.withColumns({
        "counted_seconds": F.when(counted, F.least("gap_seconds", F.lit(MAX_COUNTED_GAP))).otherwise(0),
        "counted_miles": F.when(counted, F.col("miles")).otherwise(0.0),
    })


def split_by_business_day(segments: DataFrame, zone: str = times.NEW_YORK) -> DataFrame:
    """Counted intervals cut at 04:00 local, miles in proportion to seconds."""
    end = F.col("at")
    begin = end - F.col("counted_seconds")
    first, last = times.business_date(begin, zone), times.business_date(end - 1, zone)
    days = segments.filter(F.col("counted_seconds") > 0).withColumn("nyc_date", F.explode(F.sequence(first, last)))
    low = F.greatest(begin, times.business_day_start(F.col("nyc_date"), zone))
    high = F.least(end, times.business_day_start(F.date_add("nyc_date", 1), zone))
    return days.withColumn("seconds", high - low).withColumn(
        "split_miles", F.col("counted_miles") * F.col("seconds") / F.col("counted_seconds"))


def driver_daily_stats(heartbeats: DataFrame, pickups: DataFrame | None = None, bucket_seconds: int = 3600,
                       zone: str = times.NEW_YORK) -> DataFrame:
    """Miles, hours, heartbeats, trips and pickups per driver and business date.

    One aggregation over the union of three narrow inputs: each pre-aggregates before the
    shuffle, and no join is needed.
    """
    zero, zero_d = F.lit(0).cast("long"), F.lit(0.0)
    segments = heartbeat_segments(heartbeats, bucket_seconds)
    moved = split_by_business_day(segments, zone).select(
        "user_id", "nyc_date", F.col("split_miles").alias("miles"), F.col("seconds").cast("long").alias("seconds"),
        zero.alias("heartbeats"), zero.alias("trips"), zero.alias("pickups"))
    beats = heartbeats.select(
        "user_id", times.business_date(F.col("at"), zone).alias("nyc_date"), zero_d.alias("miles"), zero.alias("seconds"),
        F.lit(1).cast("long").alias("heartbeats"), zero.alias("trips"), zero.alias("pickups"))
    rows = moved.unionByName(beats)
    if pickups is not None:
        rows = rows.unionByName(pickups.select(
            "user_id", times.business_date(F.col("created_at"), zone).alias("nyc_date"), zero_d.alias("miles"),
            zero.alias("seconds"), zero.alias("heartbeats"), F.lit(1).cast("long").alias("trips"),
            F.col("counted_for_stats").cast("long").alias("pickups")))
    return rows.groupBy("user_id", "nyc_date").agg(
        F.sum("miles").alias("miles_worked"), (F.sum("seconds") / 3600.0).alias("hours_worked"),
        F.sum("heartbeats").alias("heartbeat_count"), F.sum("trips").alias("trips_recorded"),
        F.sum("pickups").alias("pickups_recorded"))


def period_bounds(day: Column, period: str) -> tuple[Column, Column, Column]:
    """First date, last date and key of the period that holds ``day``."""
    if period == "daily":
        return day, day, day.cast("string")
    if period == "weekly":
        start = F.date_sub(day, F.weekday(day))
        end = F.date_add(start, 6)
        return start, end, F.concat_ws("_", start.cast("string"), end.cast("string"))
    if period == "monthly":
        return F.trunc(day, "month"), F.last_day(day), F.date_format(day, "yyyy-MM")
    if period == "yearly":
        start = F.trunc(day, "year")
        return start, F.date_sub(F.add_months(start, 12), 1), F.year(day).cast("string")
    raise ValueError(f"unknown period: {period}")


def active_users(users: DataFrame) -> DataFrame:
    """Users neither disabled nor suspended; a null flag counts as not set."""
    return users.filter(~lenient_true(F.col("is_disabled")) & ~lenient_true(F.col("is_suspended")))


def public_name() -> Column:
    """Display name, else the local part of the e-mail; 28 characters at most."""
    name = F.trim(F.coalesce("display_name", F.lit("")))
    local = F.when(F.col("email").contains("@"), F.substring_index(F.trim("email"), "@", 1)).otherwise("Driver")
    return F.substring(F.when(name != "", name).otherwise(local), 1, 28)


def badge(rank: Column) -> Column:
    out = None
    for position, code in BADGES:
        out = F.when(rank == position, code) if out is None else out.when(rank == position, code)
    return out


def period_totals(stats: DataFrame, users: DataFrame, metric: str, start: Column, end: Column) -> DataFrame:
    """Metric total per active user with work in [start, end]; days without a value count as 0."""
    total = F.coalesce(F.sum(metric), F.lit(0)).alias("metric_value")
    totals = stats.filter(F.col("nyc_date").between(start, end)).groupBy("user_id").agg(total)
    named = active_users(users).select("user_id", public_name().alias("display_name"))
    return totals.join(named, "user_id")


def leaderboard(stats: DataFrame, users: DataFrame, metric: str, period: str, today: Column, limit: int | None = 10) -> DataFrame:
    """Ranked totals of the period around ``today``. ``limit=None`` ranks everybody."""
    start, end, key = period_bounds(today, period)
    totals = period_totals(stats, users, metric, start, end)
    if limit is None:
        ranked = with_global_rank(totals, "metric_value", "user_id")
    else:
        top = totals.orderBy(F.desc("metric_value"), "user_id").limit(limit)
        order = Window.partitionBy(F.lit(1)).orderBy(F.desc("metric_value"), "user_id")
        ranked = top.withColumn("rank_position", F.row_number().over(order).cast("long"))
    return ranked.withColumns({"period_key": key, "badge_code": badge(F.col("rank_position"))})


def my_rank(stats: DataFrame, users: DataFrame, user_id: int, metric: str, period: str, today: Column) -> DataFrame:
    """One user's total and rank: 1 + users ahead, a count rather than a sort.

    The user's own rows are read by id; the totals of all users are made once.
    """
    start, end, key = period_bounds(today, period)
    own = F.col("user_id") == user_id
    mine = period_totals(stats.filter(own), users.filter(own), metric, start, end)
    totals = period_totals(stats, users, metric, start, end)
    value = mine.select("metric_value").scalar()
    ahead = totals.agg(F.count_if((F.col("metric_value") > value)
                                  | ((F.col("metric_value") == value) & (F.col("user_id") < user_id)))).scalar()
    return mine.withColumn("rank_position", ahead + 1).withColumns(
        {"period_key": key, "badge_code": badge(F.col("rank_position"))})


def current_badges(stats: DataFrame, users: DataFrame, today: Column) -> DataFrame:
    """Podium of the day by miles; the best badge per user."""
    podium = leaderboard(stats, users, "miles_worked", "daily", today, limit=3)
    return podium.groupBy("user_id").agg(F.min("rank_position").alias("rank_position"),
                                         F.min_by("period_key", "rank_position").alias("period_key")).withColumn(
        "badge_code", badge(F.col("rank_position")))


def user_overview(stats: DataFrame, today: Column) -> DataFrame:
    """Miles, hours and pickups of the four current periods and of the lifetime, in one pass."""
    out = []
    for period in PERIODS:
        start, end, _ = period_bounds(today, period)
        inside = F.col("nyc_date").between(start, end)
        for name in ("miles_worked", "hours_worked", "pickups_recorded"):
            out.append(F.sum(F.when(inside, F.col(name)).otherwise(F.lit(0))).alias(f"{period}_{name.split('_')[0]}"))
    life = [F.sum(name).alias(f"lifetime_{name.split('_')[0]}") for name in ("miles_worked", "hours_worked", "pickups_recorded")]
    return stats.groupBy("user_id").agg(*out, *life)


def level_thresholds(spark: SparkSession) -> DataFrame:
    """Cumulative XP at which each of the 1000 levels starts, with its band."""
    i = F.col("level") - 1
    step = F.when(i == 0, 0.0).otherwise(rounded_even(120 + i * 26 + F.pow(i, F.lit(1.28)) * 7))
    total = F.sum(step).over(Window.partitionBy(F.lit(1)).orderBy("level"))
    band = (F.floor((F.col("level") - 1) / LEVELS_PER_BAND) + 1).cast("int")
    return spark.range(1, MAX_LEVEL + 1).select(F.col("id").cast("int").alias("level")).select(
        "level", total.cast("long").alias("xp"), band.alias("band"),
        F.format_string("Band %03d", band).alias("rank_name"), F.format_string("band_%03d", band).alias("rank_icon_key"))


def with_level(df: DataFrame, xp: str = "total_xp") -> DataFrame:
    """Level, band and XP to the next level.

    The 1000 thresholds are one array from a scalar subquery; a level is a count over it, so
    there is no range join.
    """
    table = level_thresholds(df.sparkSession).agg(F.sort_array(F.collect_list("xp"))).scalar()
    df = df.withColumn("_t", table)
    df = df.withColumn("level", F.size(F.filter("_t", lambda t: t <= F.greatest(F.col(xp), F.lit(0)))))
    band = (F.floor((F.col("level") - 1) / LEVELS_PER_BAND) + 1).cast("int")
    upcoming = F.when(F.col("level") < MAX_LEVEL, F.get("_t", F.col("level")))
    return df.withColumns({
        "rank_name": F.format_string("Band %03d", band), "rank_icon_key": F.format_string("band_%03d", band),
        "current_level_xp": F.element_at("_t", F.col("level")), "next_level_xp": upcoming,
        "xp_to_next_level": F.coalesce(F.greatest(upcoming - F.col(xp), F.lit(0)), F.lit(0)),
        "max_level_reached": F.col("level") == MAX_LEVEL,
    }).drop("_t")


def daily_xp() -> dict[str, Column]:
    """XP of one driver-day, rounded per day as it accrues."""
    reports = F.least(F.greatest(F.coalesce("pickups_recorded", F.lit(0)), F.lit(0)), F.lit(PICKUPS_PER_DAY))
    return {
        "miles_xp": rounded_even(F.coalesce("miles_worked", F.lit(0)) * XP_PER_MILE).cast("long"),
        "hours_xp": rounded_even(F.coalesce("hours_worked", F.lit(0)) * XP_PER_HOUR).cast("long"),
        "report_xp": (reports * XP_PER_PICKUP).cast("long"),
    }


def progression(stats: DataFrame, game_awards: DataFrame | None = None) -> DataFrame:
    """Lifetime XP by source and the level reached, per user with work or games."""
    zero = F.lit(0).cast("long")
    rows = stats.select("user_id", "miles_worked", "hours_worked", "pickups_recorded", *[c.alias(n) for n, c in daily_xp().items()],
                        zero.alias("game_xp"))
    if game_awards is not None:
        rows = rows.unionByName(game_awards.select("user_id", F.col("xp_awarded").cast("long").alias("game_xp")), allowMissingColumns=True)
    sums = rows.groupBy("user_id").agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (
            ("miles_worked", "lifetime_miles"), ("hours_worked", "lifetime_hours"), ("pickups_recorded", "lifetime_pickups"),
            ("miles_xp", "miles_xp"), ("hours_xp", "hours_xp"), ("report_xp", "report_xp"), ("game_xp", "game_xp"))])
    return with_level(sums.withColumn("total_xp", F.col("miles_xp") + F.col("hours_xp") + F.col("report_xp") + F.col("game_xp")))


def period_report(stats: DataFrame, users: DataFrame, sent: DataFrame, today: Column, period: str, preferences: DataFrame) -> DataFrame:
    """Totals, both ranks and best badge of the last complete period for users to be mailed.

    Those are active users with an e-mail address who asked for this kind of report
    (``<period>_enabled`` of ``preferences``; no row is no) and did not get it yet. A user without
    work in the period has zeros, no ranks and no badge. Ranks count all active users.
    """
    this_start, _, _ = period_bounds(today, period)
    start, end, key = period_bounds(F.date_sub(this_start, 1), period)
    inside = stats.filter(F.col("nyc_date").between(start, end))
    totals = inside.groupBy("user_id").agg(F.sum("miles_worked").alias("miles"), F.sum("hours_worked").alias("hours"),
                                           F.sum("pickups_recorded").alias("pickups"))
    totals = totals.join(active_users(users).select("user_id", "email", public_name().alias("display_name")), "user_id")
    ranked = with_global_rank(with_global_rank(totals, "miles", "user_id", "miles_rank"), "hours", "user_id", "hours_rank")
    wants = preferences.filter(lenient_true(F.col(f"{period}_enabled"))).select("user_id").distinct()
    readers = active_users(users).filter(F.trim("email") != "").select("user_id", "email", public_name().alias("display_name")).join(wants, "user_id", "left_semi")
    already = sent.filter(F.col("report_type") == period).select("user_id", F.col("period_key"))
    out = readers.withColumn("period_key", key).join(already, ["user_id", "period_key"], "left_anti").join(
        ranked.drop("email", "display_name"), "user_id", "left").fillna(0, ["miles", "hours", "pickups"])
    return out.withColumn("badge_code", badge(F.least("miles_rank", "hours_rank")))
