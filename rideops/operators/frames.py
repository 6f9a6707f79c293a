"""Frame-level recalibration, checks and review of scored zone-bins.

A frame is all zones of one bin. Everything here is per frame or per row of the scored table;
the windows partition by bin, which holds one row per zone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideops.functions.columns import clip, rating_bucket, rating_color, rounded_even
from rideops.operators.scoring import CORE_LATITUDE, CORRIDOR_ZONE_IDS, FAMILIES, V3_WEIGHTS

BIN = "bin_local_epoch"
PROFILES = tuple(V3_WEIGHTS)
# Visible mixes: citywide anchor, rank in profile, score, confidence.
CITYWIDE_MIX = (0.40, 0.46, 0.14)
PROFILE_MIX = {
    "manhattan_v3": (0.18, 0.18, 0.50, 0.14),
    "bronx_wash_heights_v3": (0.22, 0.20, 0.46, 0.12),
    "queens_v3": (0.22, 0.20, 0.46, 0.12),
    "brooklyn_v3": (0.22, 0.20, 0.46, 0.12),
    "staten_island_v3": (0.10, 0.30, 0.44, 0.16),
}
DELTA_STEP = 0.03
# Bucket order for the direction of a change.
BUCKET_ORDER = ("red", "orange", "yellow", "sky", "blue", "indigo", "purple", "green")


def eligible(profile: str) -> Column:
    """Whether a non-airport zone belongs to a profile."""
    borough = F.lower(F.coalesce("borough_name", F.lit("")))
    corridor = F.col("zone_id").isin(*CORRIDOR_ZONE_IDS)
    if profile == "citywide_v3":
        return F.lit(True)
    if profile == "bronx_wash_heights_v3":
        return borough.contains("bronx") | corridor
    if profile == "manhattan_v3":
        return borough.contains("manhattan") & ~corridor & F.coalesce(F.col("centroid_latitude") <= CORE_LATITUDE, F.lit(False))
    return borough.contains({"staten_island_v3": "staten", "brooklyn_v3": "brooklyn", "queens_v3": "queens"}[profile])


def profile_eligibility(zones: DataFrame) -> DataFrame:
    return zones.select("zone_id", *[(~F.col("airport_excluded") & eligible(p)).alias(f"eligible_{p}") for p in PROFILES])


def display_curve(x: Column) -> Column:
    return clip(0.62 * clip(x) + 0.38 * F.sqrt(clip(x)))


def _visible(df: DataFrame) -> DataFrame:
    df = df.withColumn("visible_score", display_curve(F.col("visible_base")))
    df = df.withColumn("visible_rating", rounded_even(1 + 99 * F.col("visible_score")).cast("int"))
    return df.withColumns({"visible_bucket": rating_bucket(F.col("visible_rating")), "visible_color": rating_color(F.col("visible_rating"))})


def _stable(name: str) -> Column:
    return F.round(F.coalesce(name, F.lit(0.0)), 9)


def citywide_source(scored: DataFrame, promote: bool = True) -> DataFrame:
    """Score and confidence that feed the visible citywide layer, and where they come from.

    With promotion on, a frame uses the candidate fields if any zone has one.
    """
    if not promote:
        return scored.withColumns({"source_score": F.col("score_citywide_v3"), "source_confidence": F.col("confidence_citywide_v3"),
                                   "citywide_source": F.lit("citywide_v3")})
    ready = F.max(F.col("score_citywide_v3_candidate").isNotNull()).over(Window.partitionBy(BIN))
    return scored.withColumn("_ready", ready).withColumns({
        "source_score": F.when(F.col("_ready"), F.col("score_citywide_v3_candidate")).otherwise(F.col("score_citywide_v3")),
        "source_confidence": F.when(F.col("_ready"), F.col("confidence_citywide_v3_candidate")).otherwise(F.col("confidence_citywide_v3")),
        "citywide_source": F.when(F.col("_ready"), "citywide_v3_trap_candidate").otherwise("citywide_v3_fallback_from_missing_candidate"),
    }).drop("_ready")


def _local_rank(order: list, partition: list[str]) -> Column:
    w = Window.partitionBy(*partition)
    n = F.count("*").over(w)
    return F.when(n <= 1, 0.0).otherwise((F.row_number().over(w.orderBy(*order)) - 1) / (n - 1))


def visible_citywide(scored: DataFrame, promote: bool = True) -> DataFrame:
    """Visible citywide rank, score and rating of every scored zone in its frame."""
    df = citywide_source(scored.filter(F.col("score_citywide_v3").isNotNull()), promote)
    df = df.withColumns({"_s": clip(_stable("source_score")), "_c": _stable("source_confidence")})
    df = df.withColumn("visible_rank", _local_rank(["_s", "_c", "zone_id"], [BIN]))
    rank, score, confidence = CITYWIDE_MIX
    df = df.withColumn("visible_base", clip(rank * F.col("visible_rank") + score * F.col("_s") + confidence * clip(F.col("_c"))))
    return _visible(df).drop("_s", "_c")


def visible_profiles(scored: DataFrame, promote: bool = True) -> DataFrame:
    """The same per borough profile, long form: one row per bin, zone and profile.

    The profiles are stacked, so one window ranks all of them.
    """
    city = visible_citywide(scored, promote).withColumn("anchor", F.col("visible_base"))
    stacked = F.array_compact(F.array(*[
        F.when(eligible(p) & F.col(f"score_{p}").isNotNull(), F.struct(
            F.lit(p).alias("profile"), _stable(f"score_{p}").alias("score"), _stable(f"confidence_{p}").alias("confidence"),
            *[F.lit(m).alias(f"m{i}") for i, m in enumerate(mix)]))
        for p, mix in PROFILE_MIX.items()]))
    rows = city.select(BIN, "zone_id", "anchor", F.explode(stacked).alias("p")).select(BIN, "zone_id", "anchor", "p.*")
    rows = rows.withColumn("visible_rank", _local_rank(["score", "confidence", "zone_id"], [BIN, "profile"]))
    base = clip(F.col("m0") * clip(F.col("anchor")) + F.col("m1") * F.col("visible_rank") + F.col("m2") * clip(F.col("score"))
                + F.col("m3") * clip(F.col("confidence")))
    return _visible(rows.withColumn("visible_base", base)).select(
        BIN, "zone_id", "profile", "visible_rank", "visible_base", "visible_score", "visible_rating", "visible_bucket", "visible_color")


def airport_exclusion(bins: DataFrame, zones: DataFrame) -> DataFrame:
    """Airport zones of every frame: rating 1 and zero scores. Airports are a handful of zones."""
    airports = zones.filter(F.col("airport_excluded")).agg(F.sort_array(F.collect_list(F.struct("zone_id", "zone_name")))).scalar()
    rows = bins.select(BIN).distinct().select(BIN, F.explode(airports).alias("z")).select(BIN, "z.*")
    return rows.withColumns({
        "visible_rank": F.lit(0.0), "visible_base": F.lit(0.0), "visible_score": F.lit(0.0), "visible_rating": F.lit(1),
        "visible_bucket": rating_bucket(F.lit(1)), "visible_color": rating_color(F.lit(1))})


def _finite(value: Column) -> Column:
    v = value.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)


def popup_metrics(df: DataFrame) -> DataFrame:
    """Pickups, area and densities with ordered fallbacks; never null, never negative.

    Input: raw_now, raw_next, raw_area, raw_density_now, raw_density_next, geometry_area,
    visible_pickups.
    """
    def at_least(value: Column, low: float, strict: bool = False) -> Column:
        return F.when(value > low if strict else value >= low, value)

    now = F.coalesce(at_least(_finite(F.col("raw_now")), 0), F.greatest(F.col("visible_pickups").cast("double"), F.lit(0.0)))
    df = df.withColumn("pickups_now", now)
    df = df.withColumns({
        "pickups_next": F.coalesce(at_least(_finite(F.col("raw_next")), 0), F.col("pickups_now")),
        "_area": F.coalesce(at_least(_finite(F.col("raw_area")), 0, True), at_least(_finite(F.col("geometry_area")), 0, True)),
    })
    for side in ("now", "next"):
        known = at_least(_finite(F.col(f"raw_density_{side}")), 0)
        df = df.withColumn(f"_d_{side}", F.coalesce(known, F.col(f"pickups_{side}") / F.col("_area")))
    implied = (F.when(F.col("_d_now") > 0, F.greatest(F.col("pickups_now") / F.col("_d_now"), F.lit(0.01)))
               .when(F.col("_d_next") > 0, F.greatest(F.col("pickups_next") / F.col("_d_next"), F.lit(0.01))).otherwise(1.0))
    df = df.withColumn("zone_area_sq_miles", F.greatest(F.coalesce(F.col("_area"), implied), F.lit(0.01)))
    return df.withColumns({
        f"pickups_per_sq_mile_{side}": F.coalesce(F.col(f"_d_{side}"), F.col(f"pickups_{side}") / F.col("zone_area_sq_miles"))
        for side in ("now", "next")}).drop("_area", "_d_now", "_d_next")


POPUP_FIELDS = ("pickups_now", "pickups_next", "zone_area_sq_miles", "pickups_per_sq_mile_now", "pickups_per_sq_mile_next")


def popup_consistency_check(df: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """One row per violation: not finite, negative, or count and area x density disagree."""
    reasons = []
    for f in POPUP_FIELDS:
        v = _finite(F.col(f))
        reasons.append(F.when(v.isNull(), f"invalid {f}"))
        bad = v <= 0 if f == "zone_area_sq_miles" else v < 0
        reasons.append(F.when(bad, f"{f} must be {'> 0' if f == 'zone_area_sq_miles' else '>= 0'}"))
    for side in ("now", "next"):
        gap = _finite(F.col(f"pickups_{side}")) - _finite(F.col("zone_area_sq_miles")) * _finite(F.col(f"pickups_per_sq_mile_{side}"))
        reasons.append(F.when(F.abs(gap) > tolerance, f"pickups_{side} mismatch"))
    return df.select(BIN, "zone_id", F.explode(F.array_compact(F.array(*reasons))).alias("reason"))


def rating_bucket_check(df: DataFrame, families: Sequence[str] = FAMILIES) -> DataFrame:
    """Rows whose bucket or colour does not follow from the rating, long form."""
    stacked = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"rating_{f}").alias("rating"), F.col(f"bucket_{f}").alias("bucket"),
                                 F.col(f"color_{f}").alias("color")) for f in families])
    rows = df.select(BIN, "zone_id", F.explode(stacked).alias("f")).select(BIN, "zone_id", "f.*").filter(F.col("rating").isNotNull())
    rows = rows.withColumns({"expected_bucket": rating_bucket(F.col("rating")), "expected_color": rating_color(F.col("rating"))})
    return rows.filter(~F.col("bucket").eqNullSafe(F.col("expected_bucket")) | ~F.col("color").eqNullSafe(F.col("expected_color")))


def _candidate_rows(scored: DataFrame) -> DataFrame:
    """Long form of the candidate columns for the zones eligible in each profile."""
    stacked = F.array_compact(F.array(*[F.when(eligible(p), F.struct(
        F.lit(p).alias("profile"), F.coalesce(F.round(f"delta_{p}", 9), F.lit(0.0)).alias("delta"),
        F.col(f"bucket_{p}").alias("live_bucket"), F.col(f"bucket_{p}_candidate").alias("candidate_bucket"),
        F.col(f"rating_{p}").alias("live_rating"), F.col(f"rating_{p}_candidate").alias("candidate_rating"))) for p in PROFILES]))
    return scored.select(BIN, "zone_id", "zone_name", "borough_name", F.explode(stacked).alias("c")).select(
        BIN, "zone_id", "zone_name", "borough_name", "c.*")


def bucket_direction(live: Column, candidate: Column) -> Column:
    order = F.array(*[F.lit(b) for b in BUCKET_ORDER])
    a, b = F.array_position(order, live), F.array_position(order, candidate)
    known = live.isNotNull() & candidate.isNotNull() & (a > 0) & (b > 0)
    return F.when(~known, "unknown").when(b > a, "better").when(b < a, "worse").otherwise("same")


def candidate_review_frame(scored: DataFrame) -> DataFrame:
    """Per frame and profile: how many zones the candidate changes, promotes or demotes."""
    d = F.col("delta")
    return _candidate_rows(scored).groupBy(BIN, "profile").agg(
        F.count("*").alias("eligible_zones"), F.count_if(F.abs(d) > 0.000001).alias("changed"), F.count_if(d > DELTA_STEP).alias("promoted"),
        F.count_if(d < -DELTA_STEP).alias("demoted"), F.count_if(d.between(-DELTA_STEP, DELTA_STEP)).alias("near_unchanged"),
        F.avg(d).alias("average_delta"), F.median(d).alias("median_delta"), F.min(d).alias("min_delta"), F.max(d).alias("max_delta"))


def candidate_review_top(scored: DataFrame, k: int = 20) -> DataFrame:
    """The k largest demotions and promotions per frame and profile."""
    rows = _candidate_rows(scored).withColumn("direction", bucket_direction(F.col("live_bucket"), F.col("candidate_bucket")))
    part = Window.partitionBy(BIN, "profile")
    rows = rows.withColumns({"demotion_rank": F.row_number().over(part.orderBy("delta", "zone_id")),
                             "promotion_rank": F.row_number().over(part.orderBy(F.desc("delta"), "zone_id"))})
    return rows.filter((F.col("demotion_rank") <= k) | (F.col("promotion_rank") <= k))


def candidate_review_totals(scored: DataFrame) -> DataFrame:
    d = F.col("delta")
    return _candidate_rows(scored).groupBy("profile").agg(
        F.count_distinct(BIN).alias("frames"), F.count("*").alias("zone_observations"), F.count_if(d > DELTA_STEP).alias("promoted"),
        F.count_if(d < -DELTA_STEP).alias("demoted"), F.avg(d).alias("average_delta"), F.min(d).alias("min_delta"), F.max(d).alias("max_delta"))


def candidate_review_month(scored: DataFrame, k: int = 30) -> DataFrame:
    """Zones that recur among the per-frame top 20, by average delta; k per profile and side."""
    top = candidate_review_top(scored)
    d = F.col("delta")
    sides = F.array_compact(F.array(
        F.when((F.col("demotion_rank") <= 20) & (d < -DELTA_STEP), "demotion"), F.when((F.col("promotion_rank") <= 20) & (d > DELTA_STEP), "promotion")))
    zones = top.withColumn("side", F.explode(sides)).groupBy("profile", "side", "zone_id", "zone_name", "borough_name").agg(
        F.count("*").alias("appearances"), F.sum("delta").alias("cumulative_delta"), F.min("delta").alias("worst_delta"), F.max("delta").alias("best_delta"))
    zones = zones.withColumn("average_delta", F.round(F.col("cumulative_delta") / F.col("appearances"), 9))
    sign = F.when(F.col("side") == "promotion", -1).otherwise(1)
    order = Window.partitionBy("profile", "side").orderBy(sign * F.col("average_delta"), sign * F.round("cumulative_delta", 9), "zone_id")
    return zones.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


FIELD_GROUPS = {
    "citywide": ("rating_citywide_v3",),
    "borough": tuple(f"rating_{p}" for p in PROFILES if p != "citywide_v3"),
    "density": ("zone_area_sq_miles", "pickups_per_sq_mile_now", "pickups_per_sq_mile_next", "density_now_n", "density_next_n"),
    "trap": ("long_trip_share", "same_zone_share", "same_zone_n"),
    "popup": POPUP_FIELDS,
}


def sampled_bins(scored: DataFrame) -> DataFrame:
    """First, middle and last bin of the timeline."""
    everything = Window.partitionBy(F.lit(1))
    bins = scored.select(BIN).distinct().withColumns({
        "i": F.row_number().over(everything.orderBy(BIN)) - 1, "n": F.count("*").over(everything)})
    return bins.filter((F.col("i") == 0) | (F.col("i") == F.floor(F.col("n") / 2)) | (F.col("i") == F.col("n") - 1)).select(BIN)


def frame_field_completeness(scored: DataFrame) -> DataFrame:
    """Whether every zone of the sampled frames carries the required fields, by group."""
    def all_present(fields: Sequence[str]) -> Column:
        cond = F.lit(True)
        for f in fields:
            cond = cond & F.col(f).isNotNull()
        return F.min(cond)

    rows = scored.join(sampled_bins(scored), BIN, "left_semi")
    return rows.groupBy(BIN).agg(F.count("*").alias("features"), *[all_present(f).alias(f"has_{g}") for g, f in FIELD_GROUPS.items()])


DECILE_FACTS = ("pickups_now", "pickups_next", "pickups_per_sq_mile_now", "pickups_per_sq_mile_next", "median_driver_pay",
                "short_trip_share", "same_zone_share", "downstream_value_raw")


def score_decile_report(scored: DataFrame, families: Sequence[str] = FAMILIES) -> DataFrame:
    """Averages of eight facts per profile and rating decile. Ratings are stacked once and
    averaged in one aggregation that combines before the shuffle."""
    stacked = F.array(*[F.struct(F.lit(f).alias("profile"), F.col(f"rating_{f}").alias("rating")) for f in families])
    rows = scored.select(F.explode(stacked).alias("r"), *DECILE_FACTS).filter(F.col("r.rating").isNotNull())
    decile = F.least(F.greatest(F.ceil(F.col("r.rating") / 10), F.lit(1)), F.lit(10)).cast("int")
    return rows.groupBy(F.col("r.profile").alias("profile"), decile.alias("decile")).agg(
        F.count("*").alias("row_count"), *[F.avg(f).alias(f"avg_{f}") for f in DECILE_FACTS])


def score_decile_trend(report: DataFrame) -> DataFrame:
    """Share of adjacent deciles that move the right way; 0.70 and more counts as a trend."""
    # Facts expected to rise (1) or fall (-1) with the rating.
    expected = {"pickups_next": 1, "pickups_per_sq_mile_next": 1, "short_trip_share": -1, "same_zone_share": -1}
    all_deciles = F.array(*[F.struct(F.lit(f).alias("fact"), F.lit(s).alias("sign"), F.col(f"avg_{f}").alias("value")) for f, s in expected.items()])
    rows = report.select("profile", "decile", F.explode(all_deciles).alias("v")).select("profile", "decile", "v.*")
    w = Window.partitionBy("profile", "fact").orderBy("decile")
    rows = rows.withColumns({"following": F.lead("value").over(w), "next_decile": F.lead("decile").over(w)})
    pairs = rows.filter(F.col("value").isNotNull() & F.col("following").isNotNull() & (F.col("next_decile") == F.col("decile") + 1))
    right = (F.round(F.col("following") - F.col("value"), 9) * F.col("sign")) >= 0
    return pairs.groupBy("profile", "fact").agg(F.count("*").alias("comparisons"), F.count_if(right).alias("matching")).withColumn(
        "ratio", F.col("matching") / F.col("comparisons")).withColumn("generally", F.col("ratio") >= 0.70)
