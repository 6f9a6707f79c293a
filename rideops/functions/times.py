"""Wall-clock arithmetic on epoch seconds.

Local times are kept as "local epoch" longs (the wall clock read as if it were UTC), so no
result depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
DAY = 86400
BUSINESS_DAY_START = 4 * 3600


def local_epoch(epoch: Column, zone: str = NEW_YORK) -> Column:
    """Wall-clock seconds in ``zone`` of a UTC epoch."""
    return F.unix_timestamp(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone))


def utc_epoch(local: Column, zone: str = NEW_YORK) -> Column:
    """UTC epoch of a wall-clock second in ``zone``."""
    return F.unix_timestamp(F.to_utc_timestamp(F.timestamp_seconds(local), zone))


def floor_to(epoch: Column, seconds: int) -> Column:
    return (F.floor(epoch / seconds) * seconds).cast("long")


def epoch_date(epoch: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / DAY).cast("int"))


def date_epoch(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * DAY


def hhmm(epoch: Column) -> Column:
    minute = F.floor(F.pmod(epoch, F.lit(DAY)) / 60)
    return F.format_string("%02d:%02d", F.floor(minute / 60), minute % 60)


def monday_index(date: Column) -> Column:
    return F.weekday(date)


# Weekday names, Monday first.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
WEEKDAYS_LONG = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def weekday_name(date: Column, long: bool = False) -> Column:
    names = WEEKDAYS_LONG if long else WEEKDAYS
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.weekday(date) + 1)


def bin_label(bin_index: Column, bin_minutes: int = 20) -> Column:
    """Bin index of the day as ``h:mm AM``."""
    minute = bin_index.cast("long") * bin_minutes
    hour = F.floor(minute / 60) % 24
    twelve = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    return F.concat(
        twelve.cast("string"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"),
        F.when(hour < 12, " AM").otherwise(" PM"),
    )


def business_date(epoch: Column, zone: str = NEW_YORK) -> Column:
    """Local date of a day that starts at 04:00."""
    return epoch_date(local_epoch(epoch, zone) - BUSINESS_DAY_START)


def business_day_start(date: Column, zone: str = NEW_YORK) -> Column:
    """UTC epoch at which a business date begins (04:00 on the wall clock, DST aware)."""
    return utc_epoch(date_epoch(date) + BUSINESS_DAY_START, zone)
