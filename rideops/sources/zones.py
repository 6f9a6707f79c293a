"""Zone map: GeoJSON features to the zone dimension with area and centroid latitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rideops.operators.trip_features import with_airport_flag

MILES_PER_DEGREE = 69.0
NAME_KEYS = ("zone", "Zone", "name", "Name")
BOROUGH_KEYS = ("borough", "Borough", "boro", "Boro")
_MULTI = "array<array<array<array<double>>>>"


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zone dimension of a GeoJSON FeatureCollection.

    Properties and geometry are read as text: property spellings vary and the depth of the
    coordinates depends on the geometry type.
    """
    raw = spark.read.text(path, wholetext=True)
    features = F.from_json("value", "features array<struct<properties:string,geometry:string>>")
    return zone_dimension(raw.select(F.explode(features["features"]).alias("f")).select("f.properties", "f.geometry"))


def zones_from_features(features: DataFrame) -> DataFrame:
    """Id, name and borough from feature properties (JSON text); rows without an id are dropped."""
    def first(keys: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.get_json_object("properties", f"$.{k}")), F.lit("")) for k in keys])

    rows = features.select(
        F.get_json_object("properties", "$.LocationID").try_cast("int").alias("zone_id"),
        F.coalesce(first(NAME_KEYS), F.lit("")).alias("zone_name"), F.coalesce(first(BOROUGH_KEYS), F.lit("")).alias("borough_name"), "geometry")
    return rows.filter(F.col("zone_id").isNotNull())


def _ring_area(ring: Column) -> Column:
    """Square miles of a closed ring: shoelace on miles, longitude scaled at the ring's mean latitude."""
    n = F.size(ring)
    mean_lat = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[1]) / n
    scale = MILES_PER_DEGREE * F.cos(F.radians(mean_lat)) * MILES_PER_DEGREE
    twice = F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(0.0), lambda s, i: s + (
        ring[i][0] * ring[i + 1][1] - ring[i + 1][0] * ring[i][1]))
    return F.when((n >= 4) & (scale > 0), F.abs(twice) * 0.5 * scale)


def _polygon_area(polygon: Column) -> Column:
    """Outer ring less the holes; null when nothing is left."""
    holes = F.aggregate(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.lit(0.0),
                        lambda s, ring: s + F.coalesce(_ring_area(ring), F.lit(0.0)))
    area = _ring_area(polygon[0]) - holes
    return F.when(area > 0, area)


def zone_geometry(zones: DataFrame) -> DataFrame:
    """Area in square miles and mean vertex latitude; a narrow operator on nested arrays."""
    kind = F.get_json_object("geometry", "$.type")
    text = F.get_json_object("geometry", "$.coordinates")
    polygons = F.from_json(F.when(kind == "Polygon", F.concat(F.lit("["), text, F.lit("]"))).when(kind == "MultiPolygon", text), _MULTI)
    df = zones.withColumn("_p", polygons)
    areas = F.transform("_p", _polygon_area)
    total = F.aggregate(areas, F.lit(0.0), lambda s, a: s + F.coalesce(a, F.lit(0.0)))
    points = F.flatten(F.flatten("_p"))
    mean_lat = F.aggregate(points, F.lit(0.0), lambda s, p: s + p[1]) / F.size(points)
    return df.withColumns({
        "zone_area_sq_miles": F.when(total > 0, total), "centroid_latitude": F.when(F.size(points) > 0, mean_lat)}).drop("_p")


def zone_dimension(features: DataFrame) -> DataFrame:
    """Everything the scoring plan needs to know about zones."""
    return with_airport_flag(zone_geometry(zones_from_features(features))).drop("geometry")
