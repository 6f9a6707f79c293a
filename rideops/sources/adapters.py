"""The driver's star-schema tables viewed as this library's inputs.

Each view is a plain DataFrame over the whole table (see FIXTURES.md part 2), so every
operator can be run on data that grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIP_WEEK_START = 1736139600  # 2025-01-06 05:00 UTC, local Monday midnight
HEARTBEAT_START = 1736143200  # 2025-01-06 06:00 UTC
EVENTS_START_MICROS = 1704067200_000_000  # 2024-01-01
NOW = 1736164800  # 2025-01-06 12:00 UTC, the "now" of every query over events
FIRST_ZONE = 118
ZONE_COUNT = 25

# Borough by region key.
BOROUGHS = ("Manhattan", "Bronx", "Queens", "Brooklyn", "Staten Island")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip records in the input schema of :func:`rideops.sources.trips.normalize_trips`."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # Orders, the smaller side, go to their customers first, so that lines move once.
    home = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "c_nationkey")
    joined = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(home, line.l_orderkey == home.o_orderkey)
    day = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")) % 7
    minute = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 211 + F.col("l_partkey") * 13) % 1440
    pickup = F.lit(TRIP_WEEK_START) + day * 86400 + minute * 60
    lag = F.col("l_suppkey") % 9 - 1
    return joined.select(
        (F.col("s_nationkey") + FIRST_ZONE).cast("int").alias("PULocationID"),
        F.when(F.col("l_orderkey") % 50 == 0, F.lit(None))
        .when(F.col("l_partkey") % 23 == 0, F.lit(265))
        .otherwise(F.col("c_nationkey") + FIRST_ZONE).cast("int").alias("DOLocationID"),
        F.timestamp_seconds(pickup).alias("pickup_datetime"),
        F.timestamp_seconds(pickup - lag * 60).alias("request_datetime"),
        F.when(F.col("l_orderkey") % 97 != 0,
               (F.floor(F.col("l_extendedprice") * 100 + 0.5) % 6000) / 100.0).alias("driver_pay"),
        (240 + (F.col("l_partkey") * 17) % 2400).cast("double").alias("trip_time"),
        (F.col("l_quantity") * 0.3).alias("trip_miles"),
        F.when(F.col("l_linenumber") % 7 == 0, 1).otherwise(0).alias("shared_match_flag"),
        F.when(F.col("l_partkey") % 29 == 0, 2.5).otherwise(0.0).alias("airport_fee"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone dimension with geometry metrics."""
    key = F.col("n_nationkey")
    borough = F.element_at(F.array(*[F.lit(b) for b in BOROUGHS]), F.col("n_regionkey") + 1)
    return table(spark, sf_dir, "nation").select(
        (key + FIRST_ZONE).cast("int").alias("zone_id"),
        F.col("n_name").alias("zone_name"),
        borough.alias("borough_name"),
        (F.lit(0.2) + F.lit(0.1) * (key % 7)).alias("zone_area_sq_miles"),
        (F.lit(40.60) + F.lit(0.012) * key).alias("centroid_latitude"),
        (F.lit(-73.98) + F.lit(0.008) * (key % 5)).alias("centroid_longitude"),
    )


def _event_epoch() -> Column:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return (F.lit(HEARTBEAT_START) + F.floor((micros - EVENTS_START_MICROS) / 120e6)).cast("long")


def _event_lat(key: Column) -> Column:
    return F.lit(40.70) + (key * 37 % 1000) / 50000


def _event_lng(key: Column) -> Column:
    return F.lit(-73.98) + (key * 91 % 1000) / 50000


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All driver events with position; the base of heartbeats, pickups and recommendations."""
    return _as_user_events(table(spark, sf_dir, "events"))


def user_events_stream(spark: SparkSession, sf_dir: str, max_bytes: int = 8 << 30) -> DataFrame:
    """:func:`user_events` as a stream, with the event time as a timestamp; a trigger takes ``max_bytes`` at most, or one file."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxBytesPerTrigger", str(max_bytes)).parquet(sf_dir)
    return _as_user_events(raw).withColumn("ts", F.timestamp_seconds("at"))


def _as_user_events(events: DataFrame) -> DataFrame:
    event = F.col("event_id")
    return events.select(
        "event_id", "user_id", "event_type", _event_epoch().alias("at"),
        _event_lat(event).alias("lat"), _event_lng(event).alias("lng"),
        _event_lat(event + 1).alias("next_lat"), _event_lng(event + 1).alias("next_lng"),
        (F.lit(FIRST_ZONE) + F.col("user_id") % ZONE_COUNT).cast("int").alias("zone_id"),
        "value",
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_events(spark, sf_dir).select("event_id", "user_id", "at", "lat", "lng")


def pickups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pickup log: ``purchase`` events. Every 11th is voided; voided ones name a reason."""
    e = user_events(spark, sf_dir).filter(F.col("event_type") == "purchase")
    voided = F.col("event_id") % 11 == 0
    return e.select(
        F.col("event_id").alias("pickup_id"), "user_id", "zone_id", "lat", "lng",
        F.col("at").alias("created_at"), voided.alias("is_voided"),
        F.when(voided, F.col("at") + 1800).alias("voided_at"),
        F.when(voided, F.lit("admin")).alias("void_reason"),
        (F.col("event_id") % 7 != 0).alias("counted_for_stats"),
    )


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone and micro recommendations: ``view`` events centred on the next event's position."""
    e = user_events(spark, sf_dir).filter(F.col("event_type") == "view")
    return e.select(
        F.col("event_id").alias("recommendation_id"), "user_id", "zone_id",
        F.concat(F.lit("c"), (F.col("event_id") % 6).cast("string")).alias("cluster_id"),
        F.col("at").alias("recommended_at"),
        F.col("next_lat").alias("center_lat"), F.col("next_lng").alias("center_lng"),
        (F.col("value") % 10 / 10.0).alias("score"), (F.col("event_id") % 9 / 9.0).alias("confidence"),
    )


# Guidance actions.
GUIDANCE_ACTIONS = ("hold", "micro_reposition", "move_nearby", "wait_dispatch")


def guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events(spark, sf_dir).filter(F.col("event_type") == "click")
    action = F.element_at(F.array(*[F.lit(a) for a in GUIDANCE_ACTIONS]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("guidance_id"), "user_id", F.col("at").alias("recommended_at"),
        action.alias("action"), F.col("zone_id").alias("source_zone_id"),
        F.when(F.col("event_id") % 3 == 0, F.col("zone_id"))
        .when(F.col("event_id") % 3 == 1, F.col("zone_id") + 1).cast("int").alias("target_zone_id"),
    )


def resolved_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome log with a settled state derived from the recommendation id."""
    r = recommendations(spark, sf_dir)
    key = F.col("recommendation_id")
    converted = F.when(key % 5 == 0, F.lit(None)).otherwise(key % 3 == 0)
    return r.select(
        "*", converted.alias("converted_to_trip"),
        F.when(converted, (key % 80).cast("double")).alias("minutes_to_trip"),
        F.when(converted, (key % 40) / 100.0).alias("distance_miles"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events(spark, sf_dir).filter(F.col("event_type") == "error")
    return e.select(
        F.col("event_id").alias("report_id"), "user_id", "zone_id", "lat", "lng",
        F.when(F.col("event_id") % 4 == 0, "Police").when(F.col("event_id") % 4 == 1, "police")
        .otherwise("hazard").alias("type"),
        F.col("at").alias("created_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().select(
        "user_id",
        F.concat(F.lit("user"), user.cast("string"), F.lit("@example.com")).alias("email"),
        F.when(user % 5 != 0, F.concat(F.lit("Driver "), user.cast("string"))).alias("display_name"),
        (user % 23 == 0).alias("is_admin"),
        F.when(user % 13 == 0, F.lit(None)).otherwise(user % 17 == 0).alias("is_disabled"),
        (user % 19 == 0).alias("is_suspended"), (user % 10 == 0).alias("ghost_mode"),
        (F.lit(NOW) - (user % 40) * 86400).alias("created_at"),
        F.when(user % 3 != 0, F.lit(NOW) + (user % 15 - 7) * 86400).alias("trial_expires_at"),
        F.when(user % 6 == 0, "comp").otherwise(
            F.element_at(F.array(F.lit("active"), F.lit("trialing"), F.lit("past_due"), F.lit("cancelled"),
                                 F.lit("none")), (user % 5 + 1).cast("int"))).alias("subscription_status"),
        F.when(user % 4 != 0, F.lit(NOW) + (user % 21 - 10) * 86400).alias("subscription_current_period_end"),
        F.when((user % 6 == 0) & (user % 12 != 0), F.lit(NOW) + (user % 9 - 4) * 86400).alias("comp_expires_at"),
        F.when(user % 4 == 0, F.concat(F.lit("grandfathered:"), (user % 3).cast("string")))
        .when(user % 6 == 0, F.lit("support")).alias("comp_reason"),
    )


def daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver-day totals for the leaderboard family, from ``orders``."""
    key = F.col("o_orderkey")
    day = F.date_add(F.lit("2025-01-01").cast("date"),
                     (F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) % 365).cast("int"))
    return (
        table(spark, sf_dir, "orders")
        .select(F.col("o_custkey").alias("user_id"), day.alias("nyc_date"),
                (F.floor(F.col("o_totalprice") + 0.5) % 200).alias("miles"),
                (key % 12).alias("hours"), (key % 40).alias("pickups"))
        .groupBy("user_id", "nyc_date")
        .agg(F.sum("miles").alias("miles_worked"), F.sum("hours").alias("hours_worked"),
             F.sum("pickups").alias("pickups_recorded"))
    )


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User rows for every customer, the population of :func:`daily_stats`. Some carry stored
    subscription and customer ids."""
    user = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        user.alias("user_id"),
        F.concat(F.lit("user"), user.cast("string"), F.lit("@example.com")).alias("email"),
        F.when(user % 5 != 0, F.concat(F.lit("Driver "), user.cast("string"))).alias("display_name"),
        F.when(user % 13 == 0, F.lit(None)).otherwise(user % 17 == 0).alias("is_disabled"),
        (user % 19 == 0).alias("is_suspended"), (user % 10 == 0).alias("ghost_mode"),
        F.when(user % 2 == 0, F.concat(F.lit("sub_"), user.cast("string"))).alias("subscription_id"),
        F.when(user % 3 == 0, F.concat(F.lit("ctm_"), user.cast("string"))).alias("customer_id"),
        F.when(user % 5 == 0, "trialing").alias("subscription_status"),
        F.when(user % 4 == 0, F.lit(NOW) + user % 30 * 86400).alias("subscription_current_period_end"),
        F.when(user % 7 == 0, F.lit(NOW) + user % 500 * 60).alias("subscription_updated_at"),
    )


def battles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head-to-head challenges, one per order; status, metric and period by modulo."""
    key = F.col("o_orderkey")
    other = F.col("o_custkey") + 1 + key % 7
    start = F.date_add(F.lit("2025-01-01").cast("date"), (key % 300).cast("int"))
    length = F.element_at(F.array(F.lit(0), F.lit(6), F.lit(29)), (key % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.alias("battle_id"),
        F.when(key % 2 == 0, "miles").otherwise("hours").alias("metric"),
        F.element_at(F.array(F.lit("daily"), F.lit("weekly"), F.lit("monthly")), (key % 3 + 1).cast("int")).alias("period"),
        F.col("o_custkey").alias("challenger_id"), other.alias("challenged_id"),
        F.element_at(F.array(F.lit("pending"), F.lit("active"), F.lit("completed"), F.lit("declined")),
                     (F.floor(key / 3) % 4 + 1).cast("int")).alias("status"),
        start.alias("start_date"), F.date_add(start, length).alias("end_date"),
        (F.lit(NOW) - (key % 72) * 3600).alias("created_at"),
        (F.lit(NOW) - (key % 72) * 3600 + 86400).alias("expires_at"),
        (F.lit(NOW) + (key % 9 - 4) * 3600).alias("ends_at"),
        (key % 5).alias("challenger_start"), (key % 3).alias("challenged_start"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games between two users, one per order; some are still open, some without a winner."""
    key = F.col("o_orderkey")
    other = F.col("o_custkey") + 1 + key % 5
    winner, loser = F.when(key % 3 == 0, F.col("o_custkey")).otherwise(other), F.when(key % 3 == 0, other).otherwise(F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(
        key.alias("match_id"), F.col("o_custkey").alias("player_one_id"), other.alias("player_two_id"),
        winner.alias("winner_id"),
        F.when(key % 4 == 0, "billiards").otherwise("dominoes").alias("game_type"),
        (F.lit(NOW) - key % 5000 * 60).alias("completed_at"),
        F.when(key % 17 != 0, loser).alias("loser_id"),
        F.when(key % 10 == 0, "active").when(key % 10 == 1, "forfeited").otherwise("completed").alias("status"),
        F.when(key % 13 != 0, F.lit(60) - key % 2 * 15).alias("winner_xp_awarded"), (key % 5 * 2).alias("loser_xp_awarded"),
    )


def room_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` as a message in a public room."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        (conv * 1000 + turn).alias("message_id"),
        F.when(conv % 3 == 0, "global").otherwise(F.concat(F.lit("room"), (conv % 5).cast("string"))).alias("room"),
        F.when(F.col("role") == "user", conv % 15).otherwise((conv + 7) % 15).alias("user_id"),
        F.col("text").alias("message"),
        (F.lit(TRIP_WEEK_START - 18000) + turn * 60 - conv % 20 * 86400).alias("created_at"),
        F.when(turn % 4 == 3, "image").when(turn % 9 == 8, "voice").otherwise("text").alias("message_type"),
        F.when(turn % 4 == 3, F.concat(F.lit("img/"), (conv * 1000 + turn).cast("string"))).alias("image_path"),
        F.when((turn % 4 != 3) & (turn % 9 == 8), F.concat(F.lit("audio/"), (conv * 1000 + turn).cast("string"))).alias("audio_path"),
    )


def private_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` as a direct message."""
    conv, turn = F.col("conv_id"), F.col("turn")
    from_user = F.col("role") == "user"
    return table(spark, sf_dir, "conversations").select(
        (conv * 1000 + turn).alias("message_id"),
        F.when(from_user, conv % 15).otherwise((conv + 7) % 15).alias("sender_id"),
        F.when(from_user, (conv + 7) % 15).otherwise(conv % 15).alias("recipient_id"),
        "text", (F.lit(TRIP_WEEK_START - 18000) + turn * 60 - conv % 50 * 86400).alias("created_at"),
        F.when(turn % 2 == 0, F.lit(TRIP_WEEK_START) + turn * 60).alias("read_at"),
        F.when(turn % 4 == 3, "image").otherwise("text").alias("message_type"),
        F.when(turn % 4 == 3, F.concat(F.lit("img/"), (conv * 1000 + turn).cast("string"))).alias("image_path"),
        F.lit(None).cast("string").alias("audio_path"),
    )


def subscription_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment provider events, one per order, raw JSON included; every 13th is redelivered."""
    return _as_subscription_events(table(spark, sf_dir, "orders"))


def subscription_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "orders").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    return _as_subscription_events(raw).withColumn("ts", F.timestamp_seconds("received_at"))


def _as_subscription_events(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    kind = F.element_at(
        F.array(F.lit("subscription.created"), F.lit("subscription.updated"), F.lit("subscription.canceled"),
                F.lit("transaction.completed"), F.lit("customer.created")), (key % 5 + 1).cast("int"))
    occurred = F.lit(NOW) + key % 997 * 60
    base = orders.select(
        (key - F.when(key % 13 == 0, 1).otherwise(0)).alias("n"), "o_custkey",
        kind.alias("event_type"), occurred.alias("occurred_at"),
        (F.lit(NOW) + key * 30).alias("received_at"), key.alias("k"))
    number, user = F.col("k"), F.col("o_custkey").cast("string")
    about, has_ids = F.col("event_type").startswith("subscription."), number % 11 != 0
    subscription = F.concat(F.lit("sub_"), user, F.when(number % 7 == 0, "b").otherwise(""))
    customer, mail = F.concat(F.lit("ctm_"), user), F.concat(F.lit("user"), user, F.lit("@example.com"))

    def iso(hours: int, zone: str) -> Column:
        return F.concat(F.date_format(F.timestamp_seconds(F.lit(NOW + 3600 * hours) + number % 60 * 86400), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))

    data = F.struct(
        F.when(~about, F.concat(F.lit("txn_"), number.cast("string"))).when(has_ids, subscription).alias("id"),
        F.when(~about & has_ids, subscription).alias("subscription_id"),
        F.when(has_ids & (number % 8).isin(1, 2, 3), customer).alias("customer_id"),
        F.when(has_ids & (number % 8).isin(5, 6, 7), F.struct(customer.alias("id"), F.when(number % 8 == 6, mail).alias("email"))).alias("customer"),
        F.when((number % 3 == 0) & (number % 15 != 0), F.struct(user.alias("user_id"))).alias("custom_data"),
        F.when(number % 9 == 0, F.concat(F.lit(" User"), user, F.lit("@Example.com "))).when(number % 9 == 2, "nobody@example.org").alias("email"),
        F.when(number % 9 == 3, mail).alias("customer_email"), F.when((number % 9).isin(2, 6), mail).alias("user_email"),
        F.element_at(F.array(F.lit("active"), F.lit("past_due"), F.lit("trialing")), (number % 3 + 1).cast("int")).alias("status"),
        F.when(number % 2 == 0, F.struct(iso(0, "Z").alias("ends_at"))).alias("current_billing_period"),
        F.when(number % 10 == 5, F.struct(iso(2, "+02:00").alias("ends_at"))).alias("billing_period"),
        F.when(number % 10 == 7, iso(0, "+00:00")).when(number % 10 == 9, "soon").alias("next_billed_at"),
    )
    event = F.struct(
        "event_type", F.when(number % 15 == 0, F.struct(F.col("o_custkey").alias("user_id"))).alias("custom_data"),
        F.when(number % 9 == 1, mail).alias("email"), data.alias("data"))
    return base.select(
        F.concat(F.lit("evt_"), F.col("n").cast("string")).alias("event_id"), "event_type",
        "occurred_at", "received_at", F.to_json(event).alias("raw_event_json"))


def experiment_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment log rows of zones and micro clusters, from ``signup`` events."""
    e = user_events(spark, sf_dir).filter(F.col("event_type") == "signup")
    key = F.col("event_id")
    return e.select(
        key.alias("bin_id"), (F.floor(F.col("at") / 1200) * 1200).alias("bin_time"), "zone_id",
        F.concat(F.lit("c"), (key % 6).cast("string")).alias("cluster_id"),
        (F.col("value") % 10 / 10.0).alias("final_score"), (key % 9 / 9.0).alias("confidence"), (key % 3 == 0).alias("recommended"))


def guidance_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity and zone context of a guidance request, one per event."""
    key = F.col("event_id")
    last = F.element_at(F.array(*[F.lit(a) for a in GUIDANCE_ACTIONS]), (key % 4 + 1).cast("int"))
    return user_events(spark, sf_dir).select(
        "event_id", "user_id", (key * 13 % 100).alias("rating"), (key * 17 % 100).alias("next_rating"),
        (key % 10 / 10.0).alias("continuation"), (key % 60).alias("tripless_minutes"), (key * 7 % 40).alias("stationary_minutes"),
        (key * 3 % 30).alias("movement_minutes"), (key % 4).alias("move_attempts"), (key % 3).alias("trips_60m"),
        (key % 2 == 1).alias("moved_since_trip"), (key % 11 / 10.0).alias("dispatch_uncertainty"),
        F.when(key % 5 != 0, key * 29 % 100).alias("best_rating"), (key % 40 / 10.0).alias("best_distance"),
        F.when(key % 7 != 0, last).alias("last_action"), (F.lit(NOW) - key % 1200).alias("last_move_at"))


def guidance_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored guidance state of two thirds of the users."""
    user = F.col("user_id")
    action = F.element_at(F.array(*[F.lit(a) for a in GUIDANCE_ACTIONS]), (user % 4 + 1).cast("int"))
    return users(spark, sf_dir).filter(user % 3 != 0).select(
        "user_id", F.when(user % 5 != 0, user % 4).alias("recent_move_attempts_without_trip"), action.alias("last_action"),
        F.when(user % 2 == 0, F.lit(NOW) + user % 600).alias("hold_until"))


def zone_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON features (JSON text) drawn around the zones: squares, every fifth one doubled
    into a MultiPolygon and every seventh with a hole. Property spellings vary."""
    z = zones(spark, sf_dir).withColumn("half", F.sqrt("zone_area_sq_miles") / 138.0)

    def ring(cx: Column, cy: Column, half: Column) -> Column:
        x0, x1, y0, y1 = cx - half, cx + half, cy - half, cy + half
        return F.array(*[F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])

    cx, cy, half = F.col("centroid_longitude"), F.col("centroid_latitude"), F.col("half")
    square = F.array(ring(cx, cy, half))
    holed = F.array(ring(cx, cy, half), ring(cx, cy, half / 4))
    double = F.array(square, F.array(ring(cx + 1.0, cy, half)))
    key = F.col("zone_id")
    geometry = (
        F.when(key % 5 == 0, F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(double), F.lit("}")))
        .otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(F.when(key % 7 == 0, holed).otherwise(square)), F.lit("}"))))
    spelled = F.when(key % 2 == 0, F.to_json(F.struct(key.cast("string").alias("LocationID"), F.col("zone_name").alias("zone"), F.col("borough_name").alias("borough"))))
    other = F.to_json(F.struct(key.alias("LocationID"), F.col("zone_name").alias("Name"), F.col("borough_name").alias("Boro")))
    return z.select(F.coalesce(spelled, other).alias("properties"), geometry.alias("geometry"))


TIMED_TABLES = (("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("events", "ts"))


def file_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File name and time of every row of three tables, as an inventory's input."""
    out = None
    for name, column in TIMED_TABLES:
        part = table(spark, sf_dir, name).select(F.col("_metadata.file_name").alias("file_name"), F.col(column).cast("timestamp").alias("t"))
        out = part if out is None else out.unionByName(part)
    return out


def zone_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with their outline as rings of [lng, lat]: a square of half side ``half`` degrees."""
    z = zones(spark, sf_dir).withColumn("half", F.sqrt("zone_area_sq_miles") / 138.0)
    x0, x1 = F.col("centroid_longitude") - F.col("half"), F.col("centroid_longitude") + F.col("half")
    y0, y1 = F.col("centroid_latitude") - F.col("half"), F.col("centroid_latitude") + F.col("half")
    ring = F.array(*[F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    return z.withColumn("rings", F.array(ring))


def zone_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a pickup point spread over its zone's square (a tenth beyond the edge)."""
    z = zones(spark, sf_dir).select("zone_id", "centroid_latitude", "centroid_longitude", (F.sqrt("zone_area_sq_miles") / 138.0 * 1.1).alias("reach"))
    e = user_events(spark, sf_dir).select("event_id", "user_id", "zone_id", "at").join(z, "zone_id")
    across = (F.col("event_id") * 37 % 1000) / 500.0 - 1.0
    up = (F.col("event_id") * 91 % 1000) / 500.0 - 1.0
    return e.select(
        "event_id", "user_id", "zone_id", F.col("at").alias("created_at"),
        (F.col("centroid_latitude") + up * up * F.signum(up) * F.col("reach")).alias("lat"),
        (F.col("centroid_longitude") + across * across * F.signum(across) * F.col("reach")).alias("lng"))
