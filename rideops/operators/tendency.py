"""Borough tendency model: how a weekday and time of day compares with the others.

Trip records are reduced once to one row per date, bin and borough. Everything after that is
bounded by the calendar and the number of boroughs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideops.functions import times
from rideops.functions.columns import rounded_even
from rideops.operators.scoring import CORRIDOR_ZONE_IDS, CORE_LATITUDE
from rideops.session import cut_lineage

# Borough keys and display names.
BOROUGH_NAMES = {
    "manhattan": "Manhattan", "brooklyn": "Brooklyn", "queens": "Queens", "bronx": "Bronx",
    "staten_island": "Staten Island", "newark_airport": "Newark Airport",
}
BOROUGH_ALIASES = {
    "manhattan": ("manhattan",), "brooklyn": ("brooklyn",), "queens": ("queens",), "bronx": ("bronx",),
    "staten_island": ("staten island", "statenisland"),
    "newark_airport": ("newark airport", "newarkairport", "ewr", "newark"),
}
# Boroughs of each scope.
SCOPES = {
    "citywide": ("manhattan", "brooklyn", "queens", "bronx", "staten_island"),
    "manhattan_mode": ("manhattan",),
    "staten_island_mode": ("staten_island",),
    "bronx_wash_heights_mode": ("bronx", "manhattan"),
    "queens_mode": ("queens",),
    "brooklyn_mode": ("brooklyn",),
    "manhattan": ("manhattan",),
    "staten_island": ("staten_island",),
    "queens": ("queens",),
    "brooklyn": ("brooklyn",),
    "bronx": ("bronx",),
    "bronx_wash_heights": ("bronx", "manhattan"),
}
# Score mix per scope: pickups, pay, breadth, min(pickups, breadth).
SCOPE_MIX = {
    "manhattan_mode": (0.57, 0.09, 0.22, 0.12),
    "staten_island_mode": (0.58, 0.24, 0.18, 0.0),
    "bronx_wash_heights_mode": (0.72, 0.12, 0.16, 0.0),
    "queens_mode": (0.67, 0.11, 0.22, 0.0),
    "brooklyn_mode": (0.80, 0.10, 0.10, 0.0),
}
DEFAULT_MIX = (0.70, 0.15, 0.15, 0.0)
# Highest score of the lower bands, strengths from which a sentence says stronger or weaker.
LOW_UPTO, NORMAL_UPTO = 34, 64
STRONGER_FROM, WEAKER_UPTO = 0.65, 0.34
ROOT = "root"


def borough_key(name: Column) -> Column:
    raw = F.translate(F.lower(F.trim(F.coalesce(name, F.lit("")))), "-_", "  ")
    out = None
    for key, aliases in BOROUGH_ALIASES.items():
        out = F.when(raw.isin(*aliases), key) if out is None else out.when(raw.isin(*aliases), key)
    return out.otherwise("unknown")


def borough_display(key: Column) -> Column:
    out = None
    for k, name in BOROUGH_NAMES.items():
        out = F.when(key == k, name) if out is None else out.when(key == k, name)
    return out.otherwise("Unknown")


def borough_canonical(zones: DataFrame) -> DataFrame:
    return zones.select("zone_id", borough_key(F.col("borough_name")).alias("borough_key")).withColumn(
        "borough", borough_display(F.col("borough_key")))


def local_trips(trips: DataFrame, source_tz: str | None = None, bin_minutes: int = 20) -> DataFrame:
    """Trips with local date, weekday (Monday 0) and bin of the day.

    The model reads the recorded time as local unless ``source_tz`` says otherwise.
    """
    epoch = F.unix_timestamp("pickup_datetime")
    local = epoch if source_tz is None else times.local_epoch(epoch)
    day = times.epoch_date(local)
    return trips.select(
        "zone_id", "driver_pay", day.alias("nyc_date"), F.weekday(day).alias("weekday"),
        F.floor(F.pmod(local, F.lit(times.DAY)) / (bin_minutes * 60)).cast("int").alias("bin_index"))


def daily_pickups(local: DataFrame) -> DataFrame:
    return local.groupBy("nyc_date").agg(F.count("*").alias("daily_pickups"))


def usable_dates(daily: DataFrame, floor_pickups: float = 200.0, share: float = 0.20) -> DataFrame:
    """Dates other than the first and last (when there are three or more) with enough trips.

    One row per calendar date goes in, so the unpartitioned window is small.
    """
    all_dates = Window.partitionBy(F.lit(1))
    inner = (
        daily.withColumns({"first": F.min("nyc_date").over(all_dates), "last": F.max("nyc_date").over(all_dates),
                           "n": F.count("*").over(all_dates)})
        .filter((F.col("n") < 3) | ((F.col("nyc_date") > F.col("first")) & (F.col("nyc_date") < F.col("last"))))
    )
    needed = F.greatest(F.lit(float(floor_pickups)), share * F.median("daily_pickups").over(all_dates))
    return inner.withColumn("needed", needed).filter(F.col("daily_pickups") >= F.col("needed")).select(
        "nyc_date", "daily_pickups")


def borough_bins(local: DataFrame, zones: DataFrame) -> DataFrame:
    """Trips, mean pay and distinct zones per date, weekday, bin and borough."""
    named = local.join(borough_canonical(zones), "zone_id", "left").withColumns({
        "borough_key": F.coalesce("borough_key", F.lit("unknown")), "borough": F.coalesce("borough", F.lit("Unknown"))})
    return named.groupBy("nyc_date", "weekday", "bin_index", "borough_key", "borough").agg(
        F.count("*").alias("pickups_bin"), F.avg("driver_pay").alias("avg_pay_bin"),
        F.count_distinct("zone_id").alias("active_zones_bin"))


def usable_bins(local: DataFrame, zones: DataFrame) -> DataFrame:
    """Borough bins of the usable dates.

    Trips are scanned once: the daily totals come from the bins, which are checkpointed because
    everything that follows reads them (dates x bins x boroughs rows).
    """
    bins = cut_lineage(borough_bins(local, zones))
    daily = bins.groupBy("nyc_date").agg(F.sum("pickups_bin").alias("daily_pickups"))
    return bins.join(usable_dates(daily).select("nyc_date"), "nyc_date", "left_semi")


def with_scopes(bins: DataFrame, root_only: bool = False) -> DataFrame:
    """Each row once per scope holding its borough, and once for the root model."""
    names = F.array(F.lit(ROOT)) if root_only else F.array_compact(F.array(
        F.lit(ROOT), *[F.when(F.col("borough_key").isin(*keys), F.lit(scope)) for scope, keys in SCOPES.items()]))
    return bins.withColumn("scope", F.explode(names))


def cohorts(scoped: DataFrame) -> DataFrame:
    """Means and sample size of the four cohort families of every scope, in one aggregation."""
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def family(name: str, key: Column, weekday: Column, index: Column) -> Column:
        return F.struct(F.lit(name).alias("cohort_type"), key.alias("borough_key"), weekday.alias("weekday"), index.alias("bin_index"))

    b, d, i = F.col("borough_key"), F.col("weekday"), F.col("bin_index")
    families = F.array(
        family("borough_weekday_bin", b, d, i), family("borough_bin", b, none_i, i),
        family("borough_baseline", b, none_i, none_i), family("global_bin", none_s, none_i, i))
    spread = scoped.select("scope", F.explode(families).alias("f"), "pickups_bin", "avg_pay_bin", "active_zones_bin")
    return spread.groupBy("scope", "f.cohort_type", "f.borough_key", "f.weekday", "f.bin_index").agg(
        F.count("*").alias("sample_bins"),
        rounded_even(F.avg("pickups_bin"), 2).alias("pickups_avg"),
        rounded_even(F.avg(F.coalesce("avg_pay_bin", F.lit(0.0))), 2).alias("pay_avg"),
        rounded_even(F.avg("active_zones_bin"), 2).alias("zones_avg"))


def midrank(value: str, partition: list[str]) -> Column:
    """Average-rank percentile with ties; 0.5 when the family has one member."""
    family = Window.partitionBy(*partition)
    n = F.count("*").over(family)
    ties = F.count("*").over(Window.partitionBy(*partition, value))
    low = F.rank().over(family.orderBy(value)) - 1
    return F.when(n <= 1, 0.5).otherwise((2 * low + ties - 1) / 2 / (n - 1))


def score_mix(pickups: Column, pay: Column, breadth: Column) -> Column:
    def mix(w: tuple[float, ...]) -> Column:
        return w[0] * pickups + w[1] * pay + w[2] * breadth + w[3] * F.least(pickups, breadth)

    out = None
    for scope, weights in SCOPE_MIX.items():
        cond = F.col("scope") == scope
        out = F.when(cond, mix(weights)) if out is None else out.when(cond, mix(weights))
    return out.otherwise(mix(DEFAULT_MIX))


def with_strengths(cohort_rows: DataFrame) -> DataFrame:
    part = ["scope", "cohort_type"]
    return cohort_rows.withColumns({
        "pickup_strength": midrank("pickups_avg", part),
        "pay_strength": midrank("pay_avg", part),
        "breadth_strength": midrank("zones_avg", part),
    })


def with_tendency_score(df: DataFrame, bin_minutes: int = 20) -> DataFrame:
    """Score 0-100, band, label, confidence and sentence from the three strengths."""
    df = df.withColumn("score_raw", score_mix(F.col("pickup_strength"), F.col("pay_strength"), F.col("breadth_strength")))
    df = df.withColumn("score", F.least(F.greatest(rounded_even(100 * F.col("score_raw")), F.lit(0.0)), F.lit(100.0)).cast("int"))
    band = F.when(F.col("score") <= LOW_UPTO, "low").when(F.col("score") <= NORMAL_UPTO, "normal").otherwise("high")
    raw4 = rounded_even(F.col("score_raw"), 4)
    relation = (F.when(raw4 >= STRONGER_FROM, "stronger than most time blocks in this dataset")
                .when(raw4 <= WEAKER_UPTO, "weaker than most time blocks in this dataset")
                .otherwise("near the middle of this dataset"))
    borough = borough_display(F.col("borough_key"))
    label = times.bin_label(F.col("bin_index"), bin_minutes)
    weekday = F.element_at(F.array(*[F.lit(n) for n in times.WEEKDAYS_LONG]), F.col("weekday") + 1)
    kind = F.col("cohort_type")
    by_borough, by_bin = kind.startswith("borough"), kind.endswith("bin")
    sentence = F.concat(F.concat_ws(
        " ", F.lit("Typical"), F.when(by_borough, borough),
        F.when(kind == "borough_weekday_bin", F.concat(weekday, F.lit("s"))).otherwise("time blocks"),
        F.when(by_bin, F.concat(F.lit("around "), label)), F.when(~by_borough & ~by_bin, "in this dataset"), F.lit("are"), relation), F.lit("."))
    return df.withColumns({
        "band": band,
        "label": F.initcap(band),
        "confidence": rounded_even(F.least(F.lit(1.0), F.col("sample_bins") / 12.0), 2),
        "bin_label": label,
        "weekday_name": weekday,
        "sentence": sentence,
    })


def global_baseline(scoped: DataFrame, cohort_rows: DataFrame) -> DataFrame:
    """Overall (unrounded) means of a scope placed within its global-bin distribution."""
    means = scoped.groupBy("scope").agg(
        F.count("*").alias("sample_bins"), F.round(F.avg("pickups_bin"), 9).alias("mean_pickups"),
        F.round(F.avg(F.coalesce("avg_pay_bin", F.lit(0.0))), 9).alias("mean_pay"),
        F.round(F.avg("active_zones_bin"), 9).alias("mean_zones"))
    bins = cohort_rows.filter(F.col("cohort_type") == "global_bin").select("scope", "pickups_avg", "pay_avg", "zones_avg")

    def place(value: str, mean: str) -> Column:
        below = F.count_if(F.col(value) < F.col(mean))
        upto = F.count_if(F.col(value) <= F.col(mean))
        n = F.count("*")
        return F.when(n <= 1, 0.5).otherwise(F.least(F.greatest((below + upto - 1) / 2 / (n - 1), F.lit(0.0)), F.lit(1.0)))

    placed = bins.join(means, "scope").groupBy("scope", "sample_bins", "mean_pickups", "mean_pay", "mean_zones").agg(
        place("pickups_avg", "mean_pickups").alias("pickup_strength"), place("pay_avg", "mean_pay").alias("pay_strength"),
        place("zones_avg", "mean_zones").alias("breadth_strength"))
    return with_tendency_score(placed.select(
        "scope", F.lit("global_baseline").alias("cohort_type"), F.lit(None).cast("string").alias("borough_key"),
        F.lit(None).cast("int").alias("weekday"), F.lit(None).cast("int").alias("bin_index"), "sample_bins",
        rounded_even(F.col("mean_pickups"), 2).alias("pickups_avg"), rounded_even(F.col("mean_pay"), 2).alias("pay_avg"),
        rounded_even(F.col("mean_zones"), 2).alias("zones_avg"), "pickup_strength", "pay_strength", "breadth_strength"))


def tendency_model(scoped: DataFrame) -> DataFrame:
    """All cohorts and baselines of all scopes as one flat table."""
    rows = cohorts(scoped)
    return with_tendency_score(with_strengths(rows)).unionByName(global_baseline(scoped, rows))


def tendency_context(requests: DataFrame, model: DataFrame) -> DataFrame:
    """Best available cohort for requests (scope, borough_key, weekday, bin_index).

    The order is: the scope's weekday-bin, bin and baseline cohorts, then the root model's.
    Each request is expanded into its six candidate keys, so one equi-join answers all.
    """
    none_i = F.lit(None).cast("int")

    def key(priority: int, scope: Column, kind: str, weekday: Column, index: Column) -> Column:
        return F.struct(F.lit(priority).alias("priority"), scope.alias("k_scope"), F.lit(kind).alias("k_type"),
                        F.coalesce(weekday, F.lit(-1)).alias("k_weekday"), F.coalesce(index, F.lit(-1)).alias("k_bin"))

    s, root, d, i = F.col("scope"), F.lit(ROOT), F.col("weekday"), F.col("bin_index")
    candidates = F.array(
        key(1, s, "borough_weekday_bin", d, i), key(2, s, "borough_bin", none_i, i), key(3, s, "borough_baseline", none_i, none_i),
        key(4, root, "borough_weekday_bin", d, i), key(5, root, "borough_bin", none_i, i), key(6, root, "borough_baseline", none_i, none_i))
    wanted = requests.select("scope", "borough_key", "weekday", "bin_index", F.explode(candidates).alias("c")).select(
        "scope", "borough_key", "weekday", "bin_index", "c.*")
    found = model.filter(F.col("cohort_type").startswith("borough_")).select(
        F.col("scope").alias("k_scope"), F.col("cohort_type").alias("k_type"), "borough_key",
        F.coalesce("weekday", F.lit(-1)).alias("k_weekday"), F.coalesce("bin_index", F.lit(-1)).alias("k_bin"),
        "score", "confidence", "sample_bins")
    hit = wanted.join(found, ["k_scope", "k_type", "borough_key", "k_weekday", "k_bin"], "left")
    best = hit.filter(F.col("score").isNotNull() | (F.col("priority") == 6)).groupBy(
        "scope", "borough_key", "weekday", "bin_index").agg(
        F.min_by(F.struct("score", "confidence", "sample_bins", "k_scope", "k_type", "priority"),
                 F.when(F.col("score").isNull(), 99).otherwise(F.col("priority"))).alias("b"))
    fallback = (F.col("b.k_scope") == ROOT) & (F.col("scope") != ROOT)
    ok = F.col("b.score").isNotNull()
    return best.select(
        "scope", "borough_key", "weekday", "bin_index", F.col("b.score").alias("score"),
        F.col("b.confidence").alias("confidence"), F.col("b.sample_bins").alias("sample_bins"),
        F.when(ok, F.when(fallback, "root").otherwise("scope")).alias("source_layer"),
        F.when(ok, F.when(fallback, F.concat(F.lit("root_"), F.col("b.k_type"), F.lit("_fallback")))
               .otherwise(F.col("b.k_type"))).alias("source_specificity"),
        (ok & fallback).alias("broad_scope_fallback"))


def month_family_benchmark(scored: DataFrame, zones: DataFrame) -> DataFrame:
    """Average rating and count of ten families over all scored zone-bins."""
    name = F.lower("borough_name")
    corridor = F.col("zone_id").isin(*CORRIDOR_ZONE_IDS)
    core = name.contains("manhattan") & ~corridor & (F.col("centroid_latitude") < CORE_LATITUDE)
    north = name.contains("bronx") | corridor
    boroughs = {"manhattan": core, "bronx_wash_heights": north, "queens": name.contains("queens"),
                "brooklyn": name.contains("brooklyn"), "staten_island": name.contains("staten")}

    def both(profile: str) -> Column:
        return F.coalesce(f"rating_{profile}_v3", f"rating_{profile}_v2")

    families = [("citywide_all", F.lit(True), both("citywide"))]
    families += [(f"auto_{b}_citywide", boroughs[b], both("citywide")) for b in ("manhattan", "bronx_wash_heights", "queens", "brooklyn")]
    families += [(f"mode_{b}", cond, both(b)) for b, cond in boroughs.items()]
    keep = zones.filter(~F.col("airport_excluded")).select("zone_id")
    rows = scored.join(keep, "zone_id", "left_semi").select(F.explode(F.array_compact(F.array(*[
        F.when(cond & value.isNotNull(), F.struct(F.lit(key).alias("family"), value.alias("rating")))
        for key, cond, value in families]))).alias("f"))
    return rows.groupBy("f.family").agg(
        rounded_even(F.avg("f.rating"), 2).alias("average_rating"), F.count("*").alias("sample_zone_frames"))
