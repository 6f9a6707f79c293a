"""DuckDB statements for the source and sink operators."""

from __future__ import annotations

from oracle.base import r6, rounded, statement, view
from oracle import zone_bins  # noqa: F401

view("zone_squares", "SELECT *, sqrt(zone_area_sq_miles) / 138.0 AS half FROM zones", "zones")
view("file_times", """
  SELECT 'lineitem.parquet' AS file_name, l_shipdate AS t FROM lineitem UNION ALL SELECT 'orders.parquet', o_orderdate FROM orders UNION ALL SELECT 'events.parquet', ts FROM events""")
view("file_months", """
  SELECT strftime(t, '%Y-%m') AS month_key, file_name, CAST(floor(epoch(min(t))) AS BIGINT) AS first_epoch, CAST(floor(epoch(max(t))) AS BIGINT) AS last_epoch, count(*) AS rows FROM file_times GROUP BY 1, 2""", "file_times")


def _square(half: str) -> str:
    """Area of the ring: width x height in miles, width scaled at the mean of its five vertices."""
    return f"(2 * {half}) * 69.0 * cos(radians((3 * (centroid_latitude - {half}) + 2 * (centroid_latitude + {half})) / 5)) * (2 * {half}) * 69.0"


def _signature(where: str) -> str:
    entry = """'{"file_name":"' || file_name || '","first_epoch":' || first_epoch || ',"last_epoch":' || last_epoch || ',"rows":' || rows || '}'"""
    return f"SELECT month_key, sha256('[' || string_agg({entry}, ',' ORDER BY file_name) || ']') AS signature FROM file_months {where} GROUP BY 1"


_DAY = "make_timestamp(bin_local_epoch * 1000000)"


def statements() -> dict[str, str]:
    return {
        "zones_scan": statement("SELECT zone_id, zone_name, borough_name FROM zones", "zones"),
        "zone_geometry_metrics": statement(f"""
          SELECT zone_id, {r6(f"CASE WHEN zone_id % 5 = 0 THEN 2 * ({_square('half')}) WHEN zone_id % 7 = 0 THEN {_square('half')} - {_square('half / 4')} ELSE {_square('half')} END")} AS zone_area_sq_miles,
            {r6('''CASE WHEN zone_id % 5 <> 0 AND zone_id % 7 = 0 THEN ((3 * (centroid_latitude - half) + 2 * (centroid_latitude + half)) + (3 * (centroid_latitude - half / 4) + 2 * (centroid_latitude + half / 4))) / 10
              ELSE (3 * (centroid_latitude - half) + 2 * (centroid_latitude + half)) / 5 END''')} AS centroid_latitude FROM zone_squares""", "zone_squares"),
        "parquet_inventory": statement("""
          SELECT file_name, CAST(floor(epoch(min(t))) AS BIGINT) AS first_epoch, CAST(floor(epoch(max(t))) AS BIGINT) AS last_epoch, count(*) AS rows, NULL::VARCHAR AS month_key, FALSE AS same_month,
            count(*) OVER (PARTITION BY CAST(floor(epoch(min(t))) AS BIGINT), CAST(floor(epoch(max(t))) AS BIGINT)) > 1 AS same_span FROM file_times GROUP BY file_name""", "file_times"),
        "zone_bin_store": statement(f"""
          SELECT zone_id, bin_local_epoch, pickups_now, rating_citywide_v3, {rounded(['score_citywide_v3'])}, strftime({_DAY}, '%Y-%m') AS month_key FROM scored
          WHERE bin_local_epoch = (SELECT min(bin_local_epoch) FROM scored)""", "scored"),
        "frame_export": statement(f"""
          SELECT bin_local_epoch, strftime({_DAY}, '%Y-%m-%dT%H:%M:%S') AS frame_time, CAST(count(*) OVER (PARTITION BY bin_local_epoch) AS INTEGER) AS n_features, zone_id AS location_id, 'Feature' AS type,
            CASE WHEN zone_id % 5 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry_type, zone_name, borough_name AS borough, FALSE AS airport_excluded, rating_citywide_v3 AS rating, bucket_citywide_v3 AS bucket,
            pickups_now AS pickups, color_citywide_v3 AS fill, pickups_next, {r6('median_driver_pay')} AS avg_driver_pay, {r6('confidence_citywide_v3')} AS confidence FROM scored""", "scored"),
        "timeline": statement(f"""
          SELECT DISTINCT bin_local_epoch, strftime({_DAY}, '%Y-%m-%d') AS frame_date, strftime({_DAY}, '%A') AS weekday_name, strftime({_DAY}, '%H:%M') AS time_label FROM scored""", "scored"),
        "month_timeline_bootstrap": statement(f"""
          SELECT month_key, bin_local_epoch, strftime({_DAY}, '%Y-%m-%d') AS frame_date, strftime({_DAY}, '%A') AS weekday_name, strftime({_DAY}, '%I:%M %p') AS time_label, coalesce(trips, 0) AS trips
          FROM (SELECT month_key, CAST(epoch(unnest(generate_series(CAST(month_key || '-01' AS TIMESTAMP), CAST(month_key || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH - INTERVAL 20 MINUTE, INTERVAL 20 MINUTE))) AS BIGINT) AS bin_local_epoch
                FROM (SELECT DISTINCT strftime({_DAY}, '%Y-%m') AS month_key FROM binned))
          LEFT JOIN (SELECT bin_local_epoch, count(*) AS trips FROM binned GROUP BY 1) USING (bin_local_epoch)""", "binned"),
        "source_signature": statement(f"""
          SELECT c.month_key, c.signature, s.signature AS stored_signature, c.signature IS DISTINCT FROM s.signature AS is_stale
          FROM ({_signature('')}) c LEFT JOIN ({_signature("WHERE file_name <> 'events.parquet'")}) s USING (month_key)""", "file_months"),
    }
