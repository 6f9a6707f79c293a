"""Head-to-head work battles and games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideops.functions.columns import lenient_true
from rideops.operators.drivers import public_name
from rideops.operators.ordered import with_running

# Matches that award XP, presence freshness in seconds.
AWARDING = ("completed", "forfeited")
ONLINE_SECONDS = 300
MONTH_SECONDS = 30 * 86400
METRIC_COLUMNS = {"miles": "miles_worked", "hours": "hours_worked"}


def side_totals(battles: DataFrame, stats: DataFrame) -> DataFrame:
    """Period total of both sides less their start values, not below 0.

    ``start_date`` and ``end_date`` of a battle bound the days. A total is the difference of two
    running totals of the user, so a side looks up two days among the user's days and is never
    joined with the days between them. Users with very many battles or days are spread over months.
    """
    length = F.greatest("end_date", F.date_sub("start_date", 1))
    looks = F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(user).alias("user_id"), day.alias("nyc_date"), F.lit(sign).alias("sign"))
        for side, user in (("a", "challenger_id"), ("b", "challenged_id")) for day, sign in ((length, 1), (F.date_sub("start_date", 1), -1))])
    metrics = {name: F.coalesce(name, F.lit(0)).alias(name) for name in METRIC_COLUMNS.values()}
    days = stats.select("user_id", "nyc_date", F.lit(0).alias("kind"), *metrics.values())
    asked = battles.select("battle_id", "metric", F.explode(looks).alias("s")).select("battle_id", "metric", "s.*").withColumn("kind", F.lit(1))
    rows = days.unionByName(asked, allowMissingColumns=True).withColumn("at", F.unix_date("nyc_date").cast("long") * 86400)
    running = with_running(rows, "user_id", "at", ["at", "kind"], {f"sum_{m}": ("sum", F.col(m)) for m in metrics}, MONTH_SECONDS)
    value = F.coalesce(*[F.when(F.col("metric") == key, F.col(f"sum_{name}")) for key, name in METRIC_COLUMNS.items()], F.lit(0)) * F.col("sign")
    sums = running.filter("kind = 1").groupBy("battle_id").agg(
        F.sum(F.when(F.col("side") == "a", value)).alias("a_total"), F.sum(F.when(F.col("side") == "b", value)).alias("b_total"))
    out = battles.join(sums, "battle_id", "left")
    for name, total, start in (("challenger_value", "a_total", "challenger_start"), ("challenged_value", "b_total", "challenged_start")):
        gained = F.round(F.coalesce(total, F.lit(0)), 4) - F.coalesce(start, F.lit(0))
        out = out.withColumn(name, F.greatest(F.round(gained, 4), F.lit(0)))
    return out.drop("a_total", "b_total")


def battle_settlement(battles: DataFrame, stats: DataFrame, now: int) -> DataFrame:
    """Active battles past their end, with final values, winner, loser and result."""
    due = side_totals(battles.filter((F.col("status") == "active") & (F.col("ends_at") <= now)), stats)
    a, b = F.col("challenger_value"), F.col("challenged_value")
    return due.withColumns({
        "winner_id": F.when(a > b, F.col("challenger_id")).when(b > a, F.col("challenged_id")),
        "loser_id": F.when(a > b, F.col("challenged_id")).when(b > a, F.col("challenger_id")),
        "result_code": F.when(a > b, "challenger_win").when(b > a, "challenged_win").otherwise("tie"),
        "status": F.lit("completed"), "completed_at": F.lit(now).cast("long"),
    })


def battle_standings(battles: DataFrame, stats: DataFrame, today: Column) -> DataFrame:
    """Live values of active battles up to today, and who leads."""
    live = battles.filter(F.col("status") == "active").withColumn("end_date", F.least("end_date", today))
    out = side_totals(live, stats)
    a, b = F.col("challenger_value"), F.col("challenged_value")
    return out.withColumn("leader_id", F.when(a > b, F.col("challenger_id")).when(b > a, F.col("challenged_id")))


def battle_history(completed: DataFrame) -> DataFrame:
    """Completed battles once per participant, with own and opposing value."""
    sides = F.array(
        F.struct(F.col("challenger_id").alias("user_id"), F.col("challenged_id").alias("opponent_id"),
                 F.col("challenger_value").alias("my_value"), F.col("challenged_value").alias("other_value")),
        F.struct(F.col("challenged_id").alias("user_id"), F.col("challenger_id").alias("opponent_id"),
                 F.col("challenged_value").alias("my_value"), F.col("challenger_value").alias("other_value")))
    return completed.select("battle_id", F.concat_ws("_", "period", "metric").alias("battle_type"), "result_code",
                            F.explode(sides).alias("s")).select("battle_id", "battle_type", "result_code", "s.*")


def battle_conflicts(requests: DataFrame, battles: DataFrame) -> DataFrame:
    """Requests that collide with an open battle of the pair or an active battle of either user."""
    pair = [F.least("challenger_id", "challenged_id").alias("low_id"), F.greatest("challenger_id", "challenged_id").alias("high_id")]
    open_pairs = battles.filter(F.col("status").isin("pending", "active")).select("metric", "period", *pair).distinct()
    busy = battles.filter(F.col("status") == "active").select(
        "metric", "period", F.explode(F.array("challenger_id", "challenged_id")).alias("user_id")).distinct()
    asked = requests.select("battle_id", "metric", "period", "challenger_id", "challenged_id", *pair)
    hit = asked.join(open_pairs.withColumn("duplicate", F.lit(True)), ["metric", "period", "low_id", "high_id"], "left")
    for side in ("challenger", "challenged"):
        hit = hit.join(busy.withColumnRenamed("user_id", f"{side}_id").withColumn(f"{side}_busy", F.lit(True)),
                       ["metric", "period", f"{side}_id"], "left")
    overlap = F.coalesce("challenger_busy", "challenged_busy")
    return hit.select(
        "battle_id", F.coalesce("duplicate", F.lit(False)).alias("duplicate"), F.coalesce(overlap, F.lit(False)).alias("overlap"))


def expire_pending(df: DataFrame, now: int, inclusive: bool = True) -> DataFrame:
    """Pending rows past their expiry become expired."""
    due = F.col("expires_at") <= now if inclusive else F.col("expires_at") < now
    return df.withColumn("status", F.when((F.col("status") == "pending") & due, "expired").otherwise(F.col("status")))


def match_sides(matches: DataFrame) -> DataFrame:
    sides = F.array(
        F.struct(F.col("player_one_id").alias("user_id"), F.col("player_two_id").alias("opponent_id")),
        F.struct(F.col("player_two_id").alias("user_id"), F.col("player_one_id").alias("opponent_id")))
    return matches.select("match_id", "winner_id", "game_type", "completed_at", F.explode(sides).alias("s")).select(
        "match_id", "winner_id", "game_type", "completed_at", "s.*")


def game_record(matches: DataFrame, recent: int = 10) -> DataFrame:
    """Wins, losses and the newest matches per user; the top-k is cut before the shuffle."""
    sides = match_sides(matches)
    won = F.col("winner_id") == F.col("user_id")
    totals = sides.groupBy("user_id").agg(
        F.count_if(won).alias("wins"), F.count_if(F.col("winner_id").isNotNull() & ~won).alias("losses"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("match_id"))
    top = sides.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= recent)
    lists = top.groupBy("user_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("n", "match_id"))), lambda r: r.match_id.cast("string")), ",").alias("recent_matches"))
    return totals.join(lists, "user_id", "left").withColumn("matches_played", F.col("wins") + F.col("losses"))


def game_xp(matches: DataFrame) -> DataFrame:
    """One award per match and user, however often the match is delivered.

    Completed and forfeited matches award what they say (``winner_xp_awarded`` and
    ``loser_xp_awarded``, null: 0) to the winner and the loser they name. Deliveries that differ
    award the least of what they say.
    """
    sides = F.array(F.struct(F.col("winner_id").alias("user_id"), F.col("winner_xp_awarded").alias("xp")),
                    F.struct(F.col("loser_id").alias("user_id"), F.col("loser_xp_awarded").alias("xp")))
    named = matches.filter(F.col("status").isin(*AWARDING)).select("match_id", F.explode(sides).alias("s")).filter("s.user_id is not null")
    return named.groupBy("match_id", "s.user_id").agg(F.min(F.coalesce("s.xp", F.lit(0))).alias("xp_awarded"))


def user_cards(users: DataFrame, presence: DataFrame, levels: DataFrame, badges: DataFrame, now: int) -> DataFrame:
    online = (
        (F.col("presence_at") >= now - ONLINE_SECONDS) & ~lenient_true(F.col("ghost_mode"))
        & ~lenient_true(F.col("is_disabled")) & ~lenient_true(F.col("is_suspended")))
    return (
        users.join(presence.select("user_id", F.col("at").alias("presence_at")), "user_id", "left")
        .join(levels.select("user_id", "level", "rank_icon_key"), "user_id", "left")
        .join(badges.select("user_id", "badge_code"), "user_id", "left")
        .select("user_id", public_name().alias("display_name"), F.coalesce(online, F.lit(False)).alias("online"),
                "level", "rank_icon_key", "badge_code"))


def relationship_status(challenges: DataFrame) -> DataFrame:
    """State between viewer and target for every pair with an open battle.

    An active battle outranks a pending one; within a kind the newest counts. Pairs without a
    row here have no relationship.
    """
    sides = F.array(
        F.struct(F.col("challenger_id").alias("viewer_id"), F.col("challenged_id").alias("target_id"), F.lit("outgoing_challenge").alias("as_pending")),
        F.struct(F.col("challenged_id").alias("viewer_id"), F.col("challenger_id").alias("target_id"), F.lit("incoming_challenge").alias("as_pending")))
    rows = challenges.filter(F.col("status").isin("active", "pending")).select(
        "battle_id", "status", F.explode(sides).alias("s")).select("battle_id", "status", "s.*")
    active = F.col("status") == "active"
    return rows.groupBy("viewer_id", "target_id").agg(F.max_by(
        F.struct(F.when(active, "active_match").otherwise(F.col("as_pending")).alias("relationship"), F.col("battle_id")),
        F.struct(active.cast("int"), F.col("battle_id"))).alias("b")).select("viewer_id", "target_id", "b.relationship", "b.battle_id")
