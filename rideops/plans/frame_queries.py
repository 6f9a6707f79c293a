"""Registered queries of the frame family."""

from __future__ import annotations

from pyspark.sql import functions as F

from rideops.operators import frames as f
from rideops.plans import common
from rideops.plans.common import r6

KEY = ("bin_local_epoch", "zone_id")
VISIBLE = ("visible_rating", "visible_bucket", "visible_color")


def _step():
    return F.floor(F.col("bin_local_epoch") / 1200) + F.col("zone_id")


def visible_citywide(spark, sf):
    return f.visible_citywide(common.scored(spark, sf)).select(*KEY, "citywide_source", *r6("visible_rank", "visible_base", "visible_score"), *VISIBLE)


def visible_profiles(spark, sf):
    return f.visible_profiles(common.scored(spark, sf)).select(*KEY, "profile", *r6("visible_rank", "visible_base", "visible_score"), *VISIBLE)


def airport_exclusion(spark, sf):
    return f.airport_exclusion(common.prepared(spark, sf), common.zones(spark, sf))


def citywide_source_switch(spark, sf):
    """Every third frame loses its candidate fields, to show the fallback."""
    gone = F.floor(F.col("bin_local_epoch") / 1200) % 3 == 0
    holes = common.scored(spark, sf).withColumns({
        c: F.when(~gone, F.col(c)) for c in ("score_citywide_v3_candidate", "confidence_citywide_v3_candidate")})
    return f.citywide_source(holes).select(*KEY, "citywide_source", *r6("source_score", "source_confidence"))


def _popup(spark, sf):
    """Raw popup inputs with gaps at regular places."""
    s = _step()
    raw = common.joined(spark, sf).select(
        *KEY, F.when(s % 7 != 0, F.col("pickups_now")).alias("raw_now"), F.when(s % 5 != 0, F.col("pickups_next")).alias("raw_next"),
        F.when(s % 3 != 0, F.col("zone_area_sq_miles")).alias("raw_area"), F.when(s % 4 != 0, F.col("pickups_per_sq_mile_now")).alias("raw_density_now"),
        F.when(s % 6 == 0, -1.0).when(s % 6 != 1, F.col("pickups_per_sq_mile_next")).alias("raw_density_next"),
        F.when(s % 9 != 0, F.col("zone_area_sq_miles")).otherwise(0.0).alias("geometry_area"), (s % 13).alias("visible_pickups"))
    return f.popup_metrics(raw)


def popup_metrics(spark, sf):
    return _popup(spark, sf).select(*KEY, *r6(*f.POPUP_FIELDS))


def rating_bucket_check(spark, sf):
    s = _step()
    return f.rating_bucket_check(common.scored(spark, sf).withColumns({
        "bucket_citywide_v3": F.when(s % 50 == 0, "red").otherwise(F.col("bucket_citywide_v3")),
        "color_queens_v2": F.when(s % 60 == 0, F.lit(None)).otherwise(F.col("color_queens_v2"))}))


def candidate_review_frame(spark, sf):
    return f.candidate_review_frame(common.scored(spark, sf)).select(
        "bin_local_epoch", "profile", "eligible_zones", "changed", "promoted", "demoted", "near_unchanged",
        *r6("average_delta", "median_delta", "min_delta", "max_delta"))


def candidate_review_top(spark, sf):
    return f.candidate_review_top(common.scored(spark, sf)).select(
        *KEY, "profile", "live_rating", "candidate_rating", "direction", "demotion_rank", "promotion_rank", *r6("delta"))


def candidate_review_totals(spark, sf):
    return f.candidate_review_totals(common.scored(spark, sf)).select(
        "profile", "frames", "zone_observations", "promoted", "demoted", *r6("average_delta", "min_delta", "max_delta"))


def candidate_review_month(spark, sf):
    return f.candidate_review_month(common.scored(spark, sf)).select(
        "profile", "side", "zone_id", "zone_name", "appearances", "position", *r6("average_delta", "cumulative_delta", "worst_delta", "best_delta"))


def score_decile_report(spark, sf):
    return f.score_decile_report(common.scored(spark, sf)).select("profile", "decile", "row_count", *r6(*[f"avg_{x}" for x in f.DECILE_FACTS]))


def score_decile_trend(spark, sf):
    return f.score_decile_trend(f.score_decile_report(common.scored(spark, sf))).select(
        "profile", "fact", "comparisons", "matching", *r6("ratio"), "generally")


QUERIES = {
    "profile_eligibility": lambda s, sf: f.profile_eligibility(common.zones(s, sf)),
    "visible_citywide": visible_citywide,
    "visible_profiles": visible_profiles,
    "airport_exclusion": airport_exclusion,
    "citywide_source_switch": citywide_source_switch,
    "popup_metrics": popup_metrics,
    "popup_consistency_check": lambda s, sf: f.popup_consistency_check(_popup(s, sf)),
    "rating_bucket_check": rating_bucket_check,
    "candidate_review_frame": candidate_review_frame,
    "candidate_review_top": candidate_review_top,
    "candidate_review_totals": candidate_review_totals,
    "candidate_review_month": candidate_review_month,
    "frame_field_completeness": lambda s, sf: f.frame_field_completeness(common.scored(s, sf)),
    "score_decile_report": score_decile_report,
    "score_decile_trend": score_decile_trend,
}
