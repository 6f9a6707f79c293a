"""Registered queries of the tendency family."""

from __future__ import annotations

from pyspark.sql import functions as F

from rideops.functions import times
from rideops.operators import tendency as t
from rideops.plans import common
from rideops.plans.common import r6

STRENGTHS = ("pickup_strength", "pay_strength", "breadth_strength")
COHORT = ("scope", "cohort_type", "borough_key", "weekday", "bin_index")
SCORE = ("score", "band", "label", "confidence", "sentence")


def _local(spark, sf):
    return t.local_trips(common.trips(spark, sf))


def _usable(spark, sf):
    return t.usable_bins(_local(spark, sf), common.zones(spark, sf))


def _dated(df):
    return df.withColumn("nyc_date", F.col("nyc_date").cast("string"))


def _scored(spark, sf, root_only):
    scoped = t.with_scopes(_usable(spark, sf), root_only)
    return t.with_tendency_score(t.with_strengths(t.cohorts(scoped)))


def borough_bins(spark, sf):
    return _dated(t.borough_bins(_local(spark, sf), common.zones(spark, sf))).withColumn("avg_pay_bin", r6("avg_pay_bin")[0])


def midrank_percentile(spark, sf):
    return t.with_strengths(t.cohorts(t.with_scopes(_usable(spark, sf), True))).select(*COHORT, *r6(*STRENGTHS))


def tendency_global_baseline(spark, sf):
    scoped = t.with_scopes(_usable(spark, sf))
    return t.global_baseline(scoped, t.cohorts(scoped)).select("scope", "sample_bins", "pickups_avg", "pay_avg", "zones_avg", *r6(*STRENGTHS), *SCORE)


def tendency_context(spark, sf):
    local = _local(spark, sf).join(t.borough_canonical(common.zones(spark, sf)), "zone_id")
    asked = local.select("borough_key", "weekday", "bin_index").distinct()
    requests = asked.withColumn("scope", F.explode(F.array(*[F.lit(s) for s in (*t.SCOPES, t.ROOT)])))
    return t.tendency_context(requests, t.tendency_model(t.with_scopes(_usable(spark, sf))))


def bin_label(spark, sf):
    bins = _local(spark, sf).groupBy("bin_index").agg(F.count("*").alias("trips"))
    return bins.withColumn("bin_label", times.bin_label(F.col("bin_index")))


QUERIES = {
    "daily_pickups": lambda s, sf: _dated(t.daily_pickups(_local(s, sf))),
    "usable_dates": lambda s, sf: _dated(t.usable_dates(t.daily_pickups(_local(s, sf)))),
    "borough_bins": borough_bins,
    "borough_canonical": lambda s, sf: t.borough_canonical(common.zones(s, sf)),
    "tendency_cohorts": lambda s, sf: t.cohorts(t.with_scopes(_usable(s, sf), True)),
    "midrank_percentile": midrank_percentile,
    "tendency_score": lambda s, sf: _scored(s, sf, True).select(*COHORT, *r6("score_raw"), *SCORE),
    "tendency_global_baseline": tendency_global_baseline,
    "tendency_scopes": lambda s, sf: _scored(s, sf, False).select(*COHORT, "sample_bins", *r6("score_raw"), *SCORE),
    "tendency_context": tendency_context,
    "month_family_benchmark": lambda s, sf: t.month_family_benchmark(common.scored(s, sf), common.zones(s, sf)),
    "bin_label": bin_label,
}
