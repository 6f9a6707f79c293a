"""Registered queries of the source and sink family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideops.functions.columns import rounded
from rideops.plans import common
from rideops.plans.common import r6
from rideops.sources import adapters as a, footers, geojson, store
from rideops.sources.zones import zone_geometry, zones_from_features


def zones_scan(spark, sf):
    return zones_from_features(a.zone_features(spark, sf)).select("zone_id", "zone_name", "borough_name")


def zone_geometry_metrics(spark, sf):
    return zone_geometry(zones_from_features(a.zone_features(spark, sf))).select("zone_id", *r6("zone_area_sq_miles", "centroid_latitude"))


def parquet_inventory(spark, sf):
    """Three tables, each with a time column of its own."""
    spans = [footers.file_spans(spark, [f"{sf}/{name}.parquet"], column) for name, column in a.TIMED_TABLES]
    return store.with_inventory_warnings(store.with_month(reduce(DataFrame.unionByName, spans)))


def _monthly(spark, sf):
    """The inventory again, one entry per file and month of its rows."""
    rows = a.file_times(spark, sf)
    return rows.groupBy(F.date_format("t", "yyyy-MM").alias("month_key"), "file_name").agg(
        F.unix_timestamp(F.min("t")).alias("first_epoch"), F.unix_timestamp(F.max("t")).alias("last_epoch"), F.count("*").alias("rows"))


def source_signature(spark, sf):
    current = store.source_signature(_monthly(spark, sf))
    stored = store.source_signature(_monthly(spark, sf).filter(F.col("file_name") != "events.parquet"))
    return store.stale(current, stored)


def zone_bin_store(spark, sf):
    """Write the scored month, then read its first bin back from the store."""
    scored = common.scored(spark, sf).select("zone_id", "bin_local_epoch", "pickups_now", "rating_citywide_v3", "score_citywide_v3")
    path = store.scratch_path(spark, "zone-bins")
    store.write_month(scored, path)
    stored = spark.read.parquet(path)
    first = stored.agg(F.min("bin_local_epoch")).scalar()
    month = stored.agg(F.min("month_key")).scalar()
    return store.read_bin(spark, path, month, first).select("zone_id", "bin_local_epoch", "pickups_now", "rating_citywide_v3", *r6("score_citywide_v3"), "month_key")


def frame_export(spark, sf):
    """The frame documents, read again: one row per feature."""
    documents = geojson.frame_documents(common.scored(spark, sf), a.zone_features(spark, sf), ["zone_area_sq_miles", "pickups_next", "confidence_citywide_v3"])
    v = documents.select("bin_local_epoch", "frame_time", "n_features", F.parse_json("document").alias("v"))
    v = v.withColumn("f", F.explode(F.try_variant_get("v", "$.polygons.features", "array<variant>")))

    def of(path, kind):
        return F.try_variant_get("f", path, kind)

    p = "$.properties."
    return v.select(
        "bin_local_epoch", F.try_variant_get("v", "$.time", "string").alias("frame_time"), "n_features", of(p + "LocationID", "int").alias("location_id"),
        of("$.type", "string").alias("type"), of("$.geometry.type", "string").alias("geometry_type"), of(p + "zone_name", "string").alias("zone_name"),
        of(p + "borough", "string").alias("borough"), of(p + "airport_excluded", "boolean").alias("airport_excluded"), of(p + "rating", "int").alias("rating"),
        of(p + "bucket", "string").alias("bucket"), of(p + "pickups", "long").alias("pickups"), of(p + "style.fillColor", "string").alias("fill"),
        of(p + "pickups_next_shadow", "long").alias("pickups_next"), rounded(of(p + "avg_driver_pay", "double"), 6).alias("avg_driver_pay"),
        rounded(of(p + "confidence_citywide_v3_shadow", "double"), 6).alias("confidence"))


def timeline(spark, sf):
    return store.timeline(common.scored(spark, sf)).withColumn("frame_date", F.col("frame_date").cast("string"))


def month_timeline_bootstrap(spark, sf):
    """All bins of the months that have trips, with the trips of each."""
    trips = common.prepared(spark, sf).groupBy("bin_local_epoch").agg(F.count("*").alias("trips"))
    months = trips.select(store.month_key(F.col("bin_local_epoch")).alias("month_key")).distinct()
    bins = store.month_bins(months).join(trips, "bin_local_epoch", "left")
    return bins.withColumns({"trips": F.coalesce("trips", F.lit(0)), "frame_date": F.col("frame_date").cast("string")})


QUERIES = {
    "zones_scan": zones_scan,
    "zone_geometry_metrics": zone_geometry_metrics,
    "parquet_inventory": parquet_inventory,
    "zone_bin_store": zone_bin_store,
    "frame_export": frame_export,
    "timeline": timeline,
    "month_timeline_bootstrap": month_timeline_bootstrap,
    "source_signature": source_signature,
}
