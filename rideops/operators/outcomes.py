"""Attribution of recommendations to pickups and the reports on it."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideops.functions.columns import clip
from rideops.operators.folds import fold_sorted
from rideops.operators.ordered import with_bucket, with_previous

WINDOW_SECONDS = 5400
HOTSPOT_MAX_MILES, MICRO_MAX_MILES = 0.35, 0.20
RETENTION_SECONDS = 14 * 86400
DAY = 86400


def miles_between(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    """Scalar great-circle miles, for the folds."""
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = (math.sin((p2 - p1) / 2) ** 2
         + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lng2 - lng1) / 2) ** 2)
    return 2 * 6371000.0 * 0.000621371 * math.asin(math.sqrt(min(1.0, a)))


def best_claim(open_recs: Iterable[tuple], at: int, lat: float | None, lng: float | None, max_miles: float, fallback: bool) -> tuple[tuple, float | None] | None:
    """The open recommendation (at, id, lat, lng) a pickup takes, and its miles if it is near.

    It takes the smallest (miles to nine places, newest, largest id); one out of reach counts as
    infinitely far, and only with ``fallback``.
    """
    def distance(rec: tuple) -> float:
        miles = math.inf if None in (*rec, lat, lng) else miles_between(lat, lng, *rec[2:])
        return miles if miles <= max_miles else math.inf

    ranked = [(round(miles, 9), -rec[0], -rec[1], miles, rec) for rec in open_recs if (miles := distance(rec)) < math.inf or fallback]
    if not ranked:
        return None
    *_, miles, rec = min(ranked, key=lambda r: r[:3])
    return rec, miles if miles < math.inf else None


class OpenRecs:
    """The open recommendations (at, id, lat, lng) of one user and zone, in order of time and id.

    Each is looked at once to expire. A pickup that meets many of them measures all at once, roughly,
    and exactly only those that may be the nearest, of each place the newest.
    """

    #: So many are measured one by one. Rough miles differ from exact ones by far less than the slack.
    FEW, SLACK = 32, 1e-3

    def __init__(self, recs: Iterable[tuple] = ()) -> None:
        self._fill(list(recs))

    def _fill(self, recs: list[tuple]) -> None:
        self.recs: list[tuple | None] = []  # None once claimed or expired
        self.first = self.open = 0
        self.places = np.empty((3, max(2 * len(recs), 2 * self.FEW)))  # NaN where nothing is to be measured
        for rec in recs:
            self.append(rec)

    def __iter__(self) -> Iterator[tuple]:
        return (rec for rec in self.recs[self.first:] if rec is not None)

    def append(self, rec: tuple) -> None:
        if len(self.recs) == self.places.shape[1]:
            self._fill(list(self))
        p = math.nan if None in rec else math.radians(rec[2])
        self.places[:, len(self.recs)] = (p, math.cos(p), math.nan if None in rec else math.radians(rec[3]))
        self.recs.append(rec)
        self.open += 1

    def _drop(self, i: int) -> None:
        self.recs[i] = None
        self.places[:, i] = math.nan
        self.open -= 1

    def expire(self, at: float) -> Iterator[tuple]:
        """Those whose window has passed leave, oldest first."""
        while self.first < len(self.recs) and ((rec := self.recs[self.first]) is None or at - rec[0] > WINDOW_SECONDS):
            if rec is not None:
                self._drop(self.first)
                yield rec
            self.first += 1

    def _near(self, lat: float | None, lng: float | None, max_miles: float) -> list[int]:
        if None in (lat, lng):
            return []
        p, (lats, cosines, lngs) = math.radians(lat), self.places[:, self.first:len(self.recs)]
        a = np.sin((lats - p) / 2) ** 2 + cosines * math.cos(p) * np.sin((lngs - math.radians(lng)) / 2) ** 2
        miles = 2 * 6371000.0 * 0.000621371 * np.arcsin(np.sqrt(np.minimum(1.0, a)))
        newest: dict[tuple, int] = {}
        for i in (np.flatnonzero(miles <= min(np.fmin.reduce(miles), max_miles) + self.SLACK) + self.first).tolist():
            known = newest.get(self.recs[i][2:])
            if known is None or self.recs[i][:2] > self.recs[known][:2]:
                newest[self.recs[i][2:]] = i
        return list(newest.values())

    def claim(self, at: int, lat: float | None, lng: float | None, max_miles: float, fallback: bool) -> tuple[tuple, float | None] | None:
        """What a pickup takes by :func:`best_claim`; it is open no longer."""
        if not self.open:
            return None
        while self.recs[-1] is None:
            self.recs.pop()
        every = range(self.first, len(self.recs))
        if self.open <= self.FEW:
            meets = [i for i in every if self.recs[i] is not None]
        else:
            meets = set(self._near(lat, lng, max_miles))
            for i in reversed(every) if fallback else ():  # the newest, should none be near
                if self.recs[i] is not None and self.recs[i][:2] != self.recs[-1][:2]:
                    break
                if self.recs[i] is not None:
                    meets.add(i)
            meets = sorted(meets)
        found = best_claim([self.recs[i] for i in meets], at, lat, lng, max_miles, fallback)
        if found:
            self._drop(next(i for i in meets if self.recs[i] is found[0]))
            if len(every) > 2 * (self.open + self.FEW):
                self._fill(list(self))
        return found


def _claim(open_recs: OpenRecs, row: tuple, max_miles: float, fallback: bool) -> list[tuple]:
    """One event of a (user, zone) chain; the state holds the recommendations still open."""
    user, zone, _, at, is_pickup, event_id, lat, lng = row
    for _ in open_recs.expire(at):
        pass
    if not is_pickup:
        open_recs.append((at, event_id, lat, lng))
        return []
    found = open_recs.claim(at, lat, lng, max_miles, fallback)
    if found is None:
        return []
    rec, miles = found
    return [(user, zone, event_id, rec[1], at, (at - rec[0]) / 60.0, miles, miles is not None)]


def _linked(events: DataFrame) -> DataFrame:
    """Per (user, zone, bucket of 5400 s) what its events can reach, and the chain of the bucket.

    A pickup reaches recommendations of its own bucket and of the one before, so the first and
    last times of both kinds tell exactly whether an event has a partner at all, and whether a
    claim can cross the border of two buckets. Chains end where none can.
    """
    is_pickup, at = F.col("is_pickup"), F.col("at")
    parts = events.groupBy("user_id", "zone_id", "_bucket").agg(
        F.min(F.when(~is_pickup, at)).alias("first_rec"), F.max(F.when(~is_pickup, at)).alias("last_rec"),
        F.min(F.when(is_pickup, at)).alias("first_pickup"), F.max(F.when(is_pickup, at)).alias("last_pickup"))
    order = Window.partitionBy("user_id", "zone_id").orderBy("_bucket")
    parts = parts.withColumns({
        "rec_before": F.when(F.lag("_bucket").over(order) == F.col("_bucket") - 1, F.lag("last_rec").over(order)),
        "pickup_after": F.when(F.lead("_bucket").over(order) == F.col("_bucket") + 1, F.lead("first_pickup").over(order))})
    crossed = F.coalesce(F.col("first_pickup") - F.col("rec_before") <= WINDOW_SECONDS, F.lit(False))
    chain = F.max(F.when(~crossed, F.col("_bucket"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return parts.select("user_id", "zone_id", "_bucket", "first_rec", "last_pickup", "rec_before", "pickup_after", chain.alias("chain"))


def settle_outcomes(recommendations: DataFrame, pickups: DataFrame, max_miles: float, fallback: bool) -> DataFrame:
    """Each pickup, in time order, claims one open recommendation of its user and zone.

    The nearest centre within ``max_miles`` of those made in the last 5400 s wins, the newer on
    ties; with ``fallback`` the newest open one is taken when none is near enough. A claim closes
    the recommendation for later pickups, which makes the rule sequential. Events without a partner
    within 5400 s are dropped first, by an exact semi-join on buckets; the others are folded in
    chains that end where no claim can cross. Two scans, no checkpoint; rows without a time, user
    or zone settle nothing.
    """
    rec = recommendations.select(
        "user_id", "zone_id", F.col("recommended_at").alias("at"), F.lit(False).alias("is_pickup"),
        F.col("recommendation_id").alias("event_id"), F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"))
    pick = pickups.select(
        "user_id", "zone_id", F.col("created_at").alias("at"), F.lit(True).alias("is_pickup"),
        F.col("pickup_id").alias("event_id"), "lat", "lng")
    events = with_bucket(rec.unionByName(pick).dropna(subset=["user_id", "zone_id", "at"]), "at", WINDOW_SECONDS)
    rows = events.join(_linked(events), ["user_id", "zone_id", "_bucket"])
    at = F.col("at")
    partner = F.when(F.col("is_pickup"), (F.col("first_rec") <= at) | (F.col("rec_before") >= at - WINDOW_SECONDS)).otherwise(
        (F.col("last_pickup") >= at) | (F.col("pickup_after") <= at + WINDOW_SECONDS))
    rows = rows.filter(partner).select("user_id", "zone_id", "chain", "at", "is_pickup", "event_id", "lat", "lng")
    return fold_sorted(
        rows, ["user_id", "zone_id", "chain"], ["at", "is_pickup", "event_id"], OpenRecs,
        lambda state, row: _claim(state, row, max_miles, fallback),
        "user_id long, zone_id int, pickup_id long, recommendation_id long, settled_at long, "
        "minutes_to_trip double, distance_miles double, spatial boolean")


def settle_hotspot_outcomes(recommendations: DataFrame, pickups: DataFrame) -> DataFrame:
    return settle_outcomes(recommendations, pickups, HOTSPOT_MAX_MILES, True)


def settle_micro_outcomes(recommendations: DataFrame, pickups: DataFrame) -> DataFrame:
    return settle_outcomes(recommendations, pickups, MICRO_MAX_MILES, False)


def settle_guidance_outcomes(guidance: DataFrame, pickups: DataFrame) -> DataFrame:
    """Each pickup settles the user's newest open guidance, whatever its age.

    Taking the newest open one is bracket matching: with guidance as +1 and pickups as -1, the
    depth never falling below 0, a pickup at depth d closes the last guidance that reached d. The
    depth comes from running sums over hours, carried by one row per user and hour, so nothing is
    folded row by row, nothing is checkpointed and any user can be split.
    """
    opened = guidance.select("user_id", F.col("recommended_at").alias("at"), F.lit(0).alias("kind"), F.col("guidance_id").alias("event_id"),
                             "guidance_id", "action", "source_zone_id", "target_zone_id", F.lit(None).cast("int").alias("zone_id"))
    closed = pickups.select("user_id", F.col("created_at").alias("at"), F.lit(1).alias("kind"), F.col("pickup_id").alias("event_id"),
                            "zone_id")
    order = ["at", "kind", "event_id"]
    is_open = F.col("kind") == 0
    step = F.when(is_open, 1).otherwise(-1)
    events = with_bucket(opened.unionByName(closed, allowMissingColumns=True), "at")
    here = Window.partitionBy("user_id", "_bucket").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("_n", F.sum(step).over(upto)).withColumn("_low", F.min("_n").over(upto))
    # One row per user and bucket: how far it moves the level, and how low it goes on the way.
    parts = events.groupBy("user_id", "_bucket").agg(F.sum(step).alias("_net"), F.min("_n").alias("_least"))
    before = Window.partitionBy("user_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_level", F.coalesce(F.sum("_net").over(before), F.lit(0)))
    parts = parts.withColumn("_lowest", F.least(F.lit(0), F.coalesce(F.min(F.col("_level") + F.col("_least")).over(before), F.lit(0))))
    rows = events.join(parts.select("user_id", "_bucket", "_level", "_lowest"), ["user_id", "_bucket"])
    lowest = F.least("_lowest", F.col("_level") + F.col("_low"))
    prev_lowest = F.least("_lowest", F.col("_level") + F.lag("_low").over(here))
    rows = rows.withColumns({"level": F.col("_level") + F.col("_n"), "lowest": lowest, "prev_lowest": prev_lowest})
    # Before a pickup the depth is one more, unless the pickup found nothing open.
    depth = F.col("level") - F.col("lowest")
    unmatched = ~is_open & (F.col("level") == F.col("lowest")) & (F.col("prev_lowest") > F.col("lowest"))
    rows = rows.filter(~unmatched).withColumns({"order_key": F.struct(*order), "slot": F.struct("user_id", F.when(is_open, depth).otherwise(depth + 1).alias("depth"))})
    rows = rows.select("user_id", "at", "kind", "event_id", "guidance_id", "action", "source_zone_id", "target_zone_id", "zone_id", "order_key", "slot", "_bucket")
    found = with_previous(rows, "slot", "at", "order_key", ["guidance_id", "action", "source_zone_id", "target_zone_id", "at"])
    zone, source, target = F.col("zone_id"), F.col("prev_source_zone_id"), F.col("prev_target_zone_id")
    moves = F.col("prev_action").isin("move_nearby", "micro_reposition")
    holds = F.col("prev_action").isin("hold", "wait_dispatch")
    reason = (
        F.when(moves & (zone == target), "trip_after_move_target_zone_match")
        .when(moves & (zone != source), "trip_after_move_detected")
        .when(moves, "trip_without_material_move")
        .when(holds & (zone == source), "trip_while_holding_zone")
        .when(holds, "trip_after_hold_with_relocation").otherwise("trip_after_guidance"))
    settled = found.filter((F.col("kind") == 1) & F.col("prev_guidance_id").isNotNull()).withColumn("settlement_reason", reason)
    moved = F.col("settlement_reason").isin(
        "trip_after_move_target_zone_match", "trip_after_move_detected", "trip_after_hold_with_relocation")
    return settled.select(
        "user_id", F.col("event_id").alias("pickup_id"), F.col("prev_guidance_id").alias("guidance_id"),
        F.col("prev_action").alias("action"), F.col("at").alias("settled_at"),
        ((F.col("at") - F.col("prev_at")) / 60.0).alias("minutes_to_trip"), "settlement_reason", moved.alias("moved_before_trip"))


def outcome_recency_weight(recommended_at: Column, now: int) -> Column:
    age = F.greatest(F.lit(now) - recommended_at, F.lit(0))
    return (F.when(recommended_at.isNull(), 0.65).when(age <= DAY, 1.00).when(age <= 3 * DAY, 0.85)
            .when(age <= 7 * DAY, 0.65).otherwise(0.45))


def outcome_modifier(resolved: DataFrame, keys: Sequence[str], now: int, min_samples: int = 6,
                     target_miles: float = 0.12, span_miles: float = 0.40) -> DataFrame:
    """How much past outcomes raise or lower a zone's score, between .78 and 1.22.

    Below ``min_samples`` the modifier is neutral. Minutes to trip lie within the attribution
    window, so the median's buffer of distinct values is bounded whatever the number of rows.
    """
    w = outcome_recency_weight(F.col("recommended_at"), now)
    minutes, miles = F.col("minutes_to_trip"), F.greatest(F.col("distance_miles"), F.lit(0.0))
    has_miles = F.col("distance_miles").isNotNull()
    out = resolved.withColumn("w", w).groupBy(*keys).agg(
        F.count("*").alias("sample_count"), F.sum("w").alias("weight"),
        F.count_if(F.col("converted_to_trip")).alias("converted"),
        F.sum(F.when(F.col("converted_to_trip"), F.col("w")).otherwise(0.0)).alias("converted_weight"),
        F.median(minutes).alias("median_minutes"),
        F.sum(F.col("w") * minutes).alias("minutes_mass"), F.sum(F.when(minutes.isNotNull(), F.col("w"))).alias("minutes_weight"),
        F.sum(F.when(has_miles, F.col("w") * miles)).alias("miles_mass"), F.sum(F.when(has_miles, F.col("w"))).alias("miles_weight"),
        F.count_if(has_miles).alias("distance_samples"))
    enough = F.col("sample_count") >= max(1, min_samples)
    out = out.withColumns({
        "conversion_rate": F.col("converted_weight") / F.greatest(F.col("weight"), F.lit(0.0001)),
        "raw_conversion_rate": F.col("converted") / F.col("sample_count"),
        "minutes": F.coalesce(F.col("minutes_mass") / F.col("minutes_weight"), F.lit(15.0)),
        "miles": F.coalesce(F.col("miles_mass") / F.col("miles_weight"), F.lit(0.0)),
        "support": clip((F.col("weight") - 4.0) / 6.0),
        "median_minutes": F.coalesce("median_minutes", F.lit(15.0)),
    })
    precision = F.when(F.col("distance_samples") > 0, clip((target_miles - F.col("miles")) / span_miles, -0.08, 0.08)).otherwise(0.0)
    raw = 1.0 + (F.col("conversion_rate") - 0.45) * 0.55 + (12.0 - F.col("minutes")) / 50.0 + precision
    out = out.withColumn("raw_modifier", raw)
    modifier = clip(1.0 + (F.col("raw_modifier") - 1.0) * F.col("support"), 0.78, 1.22)

    def gated(value: Column, neutral: float) -> Column:
        return F.when(enough, value).otherwise(F.lit(neutral))

    return out.select(
        *keys, "sample_count", gated(modifier, 1.0).alias("modifier"), gated(F.col("support"), 0.0).alias("support_strength"),
        gated(F.col("conversion_rate"), 0.0).alias("conversion_rate"), gated(F.col("raw_conversion_rate"), 0.0).alias("raw_conversion_rate"),
        gated(F.col("median_minutes"), 0.0).alias("median_minutes"), gated(F.col("minutes"), 0.0).alias("weighted_minutes"),
        gated(F.col("miles"), 0.0).alias("weighted_miles"), gated(F.col("raw_modifier"), 1.0).alias("raw_modifier"))


def listing_filter(df: DataFrame, time_column: str, now: int, *, zone_id: int | None = None, cluster_id: str | None = None,
                   user_id: int | None = None, status: str | None = None, since_seconds: int | None = None,
                   recommended: bool | None = None) -> DataFrame:
    """The optional filters of the experiment reads. ``not_converted`` is an explicit false."""
    if zone_id is not None:
        df = df.filter(F.col("zone_id") == zone_id)
    if cluster_id is not None and cluster_id.strip():
        df = df.filter(F.col("cluster_id") == cluster_id.strip())
    if user_id is not None:
        df = df.filter(F.col("user_id") == user_id)
    if status is not None:
        tests = {"pending": F.col("converted_to_trip").isNull(), "converted": F.col("converted_to_trip"),
                 "not_converted": ~F.col("converted_to_trip")}
        if status.strip().lower() not in tests:
            raise ValueError("status must be pending, converted or not_converted")
        df = df.filter(tests[status.strip().lower()])
    if since_seconds is not None:
        df = df.filter(F.col(time_column) >= now - max(1, min(2_592_000, since_seconds)))
    if recommended is not None:
        df = df.filter(F.col("recommended") == recommended)
    return df


def outcome_listing(outcomes: DataFrame, now: int, limit: int, **filters) -> DataFrame:
    kept = listing_filter(outcomes, "recommended_at", now, **filters)
    status = F.when(F.col("converted_to_trip").isNull(), "pending").when(F.col("converted_to_trip"), "converted").otherwise("not_converted")
    return kept.withColumn("outcome_status", status).orderBy(F.desc("recommended_at"), F.desc("recommendation_id")).limit(limit)


def experiment_bin_listing(bins: DataFrame, now: int, limit: int, **filters) -> DataFrame:
    return listing_filter(bins, "bin_time", now, **filters).orderBy(F.desc("bin_time"), F.desc("bin_id")).limit(limit)


def _outcome_counts() -> list[Column]:
    converted = F.col("converted_to_trip")
    return [
        F.count_if(converted.isNull()).alias("pending_rows"), F.count_if(converted).alias("converted_rows"),
        F.count_if(~converted).alias("not_converted_rows"), F.count_if(converted.isNotNull()).alias("resolved_rows"),
        F.avg(F.when(converted, F.col("minutes_to_trip"))).alias("avg_minutes_converted"),
        F.avg(F.when(converted, F.col("distance_miles"))).alias("avg_miles_converted"),
    ]


def conversion_ranking(outcomes: DataFrame, keys: Sequence[str], min_resolved: int = 3, limit: int | None = 20) -> DataFrame:
    """Groups with enough resolved outcomes by rate, resolved count and recency."""
    out = outcomes.groupBy(*keys).agg(F.count("*").alias("total_rows"), *_outcome_counts(),
                                      F.max("recommended_at").alias("latest_recommended_at"))
    out = out.filter(F.col("resolved_rows") >= min_resolved).withColumn("conversion_rate", F.col("converted_rows") / F.col("resolved_rows"))
    if limit is None:
        return out
    return out.orderBy(F.desc("conversion_rate"), F.desc("resolved_rows"), F.desc("latest_recommended_at"), *keys).limit(limit)


def bin_summary(bins: DataFrame, since: int, has_clusters: bool) -> DataFrame:
    """One row: all rows, and counts, distincts and means of those since a time."""
    recent = F.col("bin_time") >= since

    def inside(c: Column) -> Column:
        return F.when(recent, c)

    clusters = F.count_distinct(inside(F.col("cluster_id"))) if has_clusters else F.lit(None).cast("long")
    return bins.agg(
        F.count("*").alias("total_rows"), F.count_if(recent).alias("recent_rows"), F.count_if(recent & F.col("recommended")).alias("recommended_rows"),
        F.count_distinct(inside(F.col("zone_id"))).alias("distinct_zones"), clusters.alias("distinct_clusters"),
        F.avg(inside(F.col("final_score"))).alias("avg_final_score"), F.avg(inside(F.col("confidence"))).alias("avg_confidence"))


def outcome_summary(outcomes: DataFrame, since: int) -> DataFrame:
    recent = outcomes.withColumn("recent", F.col("recommended_at") >= since)
    kept = F.col("recent")
    converted = F.col("converted_to_trip")
    out = recent.agg(
        F.count("*").alias("total_rows"), F.count_if(kept).alias("recent_rows"), F.count_if(kept & converted.isNull()).alias("pending_rows"),
        F.count_if(kept & converted).alias("converted_rows"), F.count_if(kept & ~converted).alias("not_converted_rows"),
        F.count_distinct(F.when(kept, F.col("zone_id"))).alias("distinct_zones"),
        F.count_distinct(F.when(kept, F.col("cluster_id"))).alias("distinct_clusters"),
        F.count_distinct(F.when(kept, F.col("user_id"))).alias("distinct_users"),
        F.avg(F.when(kept & converted, F.col("minutes_to_trip"))).alias("avg_minutes_converted"),
        F.avg(F.when(kept & converted, F.col("distance_miles"))).alias("avg_miles_converted"))
    resolved = F.col("converted_rows") + F.col("not_converted_rows")
    return out.withColumn("conversion_rate", F.when(resolved > 0, F.col("converted_rows") / resolved))


def experiment_summary(zone_bins: DataFrame, micro_bins: DataFrame, outcomes: DataFrame, micro_outcomes: DataFrame, since: int) -> DataFrame:
    """Totals and recent figures of the four experiment tables, one row per table."""
    parts = {
        "hotspot_bins": bin_summary(zone_bins, since, False), "micro_bins": bin_summary(micro_bins, since, True),
        "hotspot_outcomes": outcome_summary(outcomes, since), "micro_outcomes": outcome_summary(micro_outcomes, since),
    }
    out = None
    for name, part in parts.items():
        part = part.withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def retention_prune(df: DataFrame, time_column: str, now: int, keep_seconds: int = RETENTION_SECONDS) -> DataFrame:
    """Rows young enough to keep; write them back by overwriting their date partitions."""
    return df.filter(F.col(time_column) >= now - keep_seconds)
