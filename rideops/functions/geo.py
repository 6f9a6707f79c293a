"""Distance and projection columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius in metres, miles per metre, Mercator sphere radius.
EARTH_RADIUS_M = 6371000.0
MILES_PER_METER = 0.000621371
MERCATOR_RADIUS_M = 6378137.0
METERS_PER_MILE = 1609.344


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat = F.radians(lat2 - lat1) / 2
    dlng = F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)
    # ``least`` would turn an unknown position into half the globe.
    return 2 * EARTH_RADIUS_M * MILES_PER_METER * F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a)))


def mercator_x(lng: Column) -> Column:
    return F.radians(lng) * MERCATOR_RADIUS_M


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * MERCATOR_RADIUS_M


def inverse_mercator_lng(x: Column) -> Column:
    return F.degrees(x / MERCATOR_RADIUS_M)


def inverse_mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS_M)) - F.lit(1.5707963267948966))
