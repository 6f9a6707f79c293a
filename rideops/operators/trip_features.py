"""Per-trip columns: local time, rates, bins and flags. Narrow operators, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideops.functions import times
from rideops.functions.columns import flag

# Airport zone ids and the name tokens that mark an airport.
AIRPORT_ZONE_IDS = (1, 132, 138)
AIRPORT_TOKENS = ("airport", "jfk", "la guardia", "laguardia", "newark", "ewr")

BIN_MINUTES = 20


def airport_zone(zone_id: Column, zone_name: Column, borough: Column) -> Column:
    text = F.concat_ws(" ", *[F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")) for c in (zone_name, borough)])
    return zone_id.isin(*AIRPORT_ZONE_IDS) | text.rlike("|".join(AIRPORT_TOKENS))


def with_airport_flag(zones: DataFrame) -> DataFrame:
    return zones.withColumn(
        "airport_excluded",
        F.coalesce(airport_zone(F.col("zone_id"), F.col("zone_name"), F.col("borough_name")), F.lit(False)),
    )


def with_local_time(trips: DataFrame, source_tz: str | None = "UTC", zone: str = times.NEW_YORK) -> DataFrame:
    """Add ``local_epoch``: the pickup's wall clock. ``source_tz=None`` reads it as already local."""
    epoch = F.unix_timestamp("pickup_datetime")
    return trips.withColumn("local_epoch", epoch if source_tz is None else times.local_epoch(epoch, zone))


def with_rates(trips: DataFrame) -> DataFrame:
    """Request lag in minutes, pay per minute (at least one second) and per mile (at least 0.1)."""
    micros = F.unix_micros("pickup_datetime") - F.unix_micros("request_datetime")
    pay = F.col("driver_pay")
    return trips.withColumns({
        "request_min": micros / 60e6,
        "pay_per_min": pay / F.greatest(F.col("trip_time") / 60.0, F.lit(1.0 / 60.0)),
        "pay_per_mile": pay / F.greatest(F.col("trip_miles"), F.lit(0.1)),
    })


def with_bin(trips: DataFrame, bin_minutes: int = BIN_MINUTES) -> DataFrame:
    return trips.withColumn("bin_local_epoch", times.floor_to(F.col("local_epoch"), bin_minutes * 60))


def bin_labels(df: DataFrame) -> DataFrame:
    date = times.epoch_date(F.col("bin_local_epoch"))
    return df.withColumns({
        "bin_date": date,
        "weekday_name": times.weekday_name(date),
        "bin_time_label": times.hhmm(F.col("bin_local_epoch")),
    })


def with_trip_flags(trips: DataFrame) -> DataFrame:
    miles, seconds = F.col("trip_miles"), F.col("trip_time")
    return trips.withColumns({
        "is_short": flag((miles <= 3.0) & (seconds <= 720.0)),
        "is_shared": flag(F.col("shared_flag") == 1),
        "is_long": flag(seconds >= 1200),
        "is_balanced": flag(miles.between(3.0, 10.0) & seconds.between(720.0, 2400.0)),
        "is_same_zone": flag(F.col("drop_zone_id") == F.col("zone_id")),
    })


def with_exit_flags(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Flags for where the trip ends, from one left join to the zone dimension.

    A drop-off outside the dimension, or a null one, is out of the scored network. The zone
    dimension is joined without a hint: Spark broadcasts it while it is under the session's
    threshold and shuffles it otherwise.
    """
    dim = zones.select(F.col("zone_id").alias("drop_zone_id"), F.col("airport_excluded").alias("drop_is_airport"))
    joined = trips.join(dim, "drop_zone_id", "left")
    miles, seconds = F.col("trip_miles"), F.col("trip_time")
    scored = F.coalesce(~F.col("drop_is_airport"), F.lit(False))
    return joined.withColumns({
        "is_airport_exit": flag((F.coalesce("airport_fee", F.lit(0.0)) > 0) | F.col("drop_is_airport")),
        "is_network_drop": flag(scored),
        "is_out_of_network": flag(~scored),
        "is_short_external_6mi": flag(~scored & (miles <= 6.0) & (seconds <= 1800.0)),
        "is_short_external_8mi": flag(~scored & (miles <= 8.0) & (seconds <= 2400.0)),
        "is_long_external": flag(~scored & (miles >= 12.0) & (F.coalesce("driver_pay", F.lit(0.0)) >= 25.0)),
    }).drop("drop_is_airport")


def scored_trips(trips: DataFrame, zones: DataFrame, bin_minutes: int = BIN_MINUTES,
                 source_tz: str | None = "UTC") -> DataFrame:
    """Normalised trips of non-airport pickup zones with every per-trip column."""
    kept = trips.join(zones.filter(~F.col("airport_excluded")).select("zone_id"), "zone_id", "left_semi")
    return with_exit_flags(with_trip_flags(with_bin(with_rates(with_local_time(kept, source_tz)), bin_minutes)), zones)
