"""DuckDB statements for the hotspot operators. Zone outlines are squares, so distances and
containment have closed forms here; components come from a recursive reachability query."""

from __future__ import annotations

from oracle.base import NOW, r6, rounded, statement, view
from oracle.drivers import haversine
from oracle import outcomes  # noqa: F401

RECENT = NOW - 5400
X = "radians({0}) * 6378137.0"
Y = "ln(tan(radians({0}) / 2 + 0.7853981633974483::DOUBLE)) * 6378137.0"


def c(expr: str, low: str = "0", high: str = "1") -> str:
    return f"least(greatest({expr}, {low}), {high})"


def decay(age: str) -> str:
    return f"CASE WHEN {age} <= 720 THEN 1.0 WHEN {age} <= 1800 THEN 0.65 WHEN {age} <= 3600 THEN 0.34 WHEN {age} <= 7200 THEN 0.15 ELSE 0.06 END::DOUBLE"


view("zone_points", f"""
  SELECT event_id, user_id, zone_id, created_at, lat, lng, {X.format('lng')} AS x, {Y.format('lat')} AS y, {decay(f'({NOW} - created_at)')} AS w FROM (
    SELECT event_id, user_id, e.zone_id, seen_at AS created_at, centroid_latitude + up * up * sign(up) * reach AS lat, centroid_longitude + across * across * sign(across) * reach AS lng
    FROM (SELECT *, (event_id * 37 % 1000) / CAST(500 AS DOUBLE) - 1 AS across, (event_id * 91 % 1000) / CAST(500 AS DOUBLE) - 1 AS up FROM user_events) e
    JOIN (SELECT zone_id, centroid_latitude, centroid_longitude, sqrt(zone_area_sq_miles) / 138.0 * 1.1 AS reach FROM zones) z ON z.zone_id = e.zone_id)""", "user_events", "zones")
view("recent_points", f"SELECT * FROM zone_points WHERE created_at >= {RECENT}", "zone_points")
view("shapes", f"""
  SELECT *, {X.format('centroid_longitude - half')} AS min_x, {X.format('centroid_longitude + half')} AS max_x, {Y.format('centroid_latitude - half')} AS min_y, {Y.format('centroid_latitude + half')} AS max_y
  FROM (SELECT *, sqrt(zone_area_sq_miles) / 138.0 AS half FROM zones)""", "zones")
view("side_history", "SELECT zone_id, count(*) * CAST(0.1 AS DOUBLE) AS value FROM zone_points GROUP BY 1", "zone_points")
view("side_slot", "SELECT zone_id, count(*) * CAST(0.5 AS DOUBLE) AS value FROM recommendations GROUP BY 1", "recommendations")
view("side_density", "SELECT zone_id, count(*) * CAST(0.05 AS DOUBLE) AS value FROM reports GROUP BY 1", "reports")
view("zone_live", f"""
  SELECT zone_id, coalesce(l.weighted, 0) AS weighted, coalesce(l.u, 0) AS unique_drivers, coalesce(i.value, 0) AS history, coalesce(s.value, 0) AS slot, coalesce(d.value, 0) AS density, p.value AS previous
  FROM (SELECT zone_id, round(sum(w), 9) AS weighted, count(DISTINCT user_id) AS u FROM recent_points GROUP BY 1) l
  FULL JOIN side_history i USING (zone_id) FULL JOIN side_slot s USING (zone_id)
  LEFT JOIN side_density d USING (zone_id) LEFT JOIN (SELECT zone_id, round(avg(score), 9) AS value FROM recommendations GROUP BY 1) p USING (zone_id)""",
     "recent_points", "side_history", "side_slot", "side_density", "recommendations")
view("micro_cells", f"""
  SELECT zone_id, gx, gy, sum(w) AS weight, sum(x * w) / sum(w) AS cx, sum(y * w) / sum(w) AS cy, sum(lat * w) / sum(w) AS center_lat, sum(lng * w) / sum(w) AS center_lng,
    count(DISTINCT user_id) AS unique_drivers, count(*) AS events
  FROM (SELECT *, CAST(floor(x / 90) AS BIGINT) AS gx, CAST(floor(y / 90) AS BIGINT) AS gy FROM recent_points) GROUP BY 1, 2, 3""", "recent_points")
view("micro_scored", f"""
  SELECT *, round({c('greatest(raw, 0) * confidence')}, 9) AS final_score FROM (
    SELECT *, (0.56 * {c('history / 14')} + 0.24 * {c('adjusted / 7')} + 0.17 * {c('slot / 8')} - 0.08 * {c('density')}) * (0.85 + 0.15 * eta_alignment) AS raw,
      {c(f"0.22 + 0.38 * {c('adjusted / 6')} + 0.25 * {c('unique_drivers / 4')} + 0.15 * {c('slot / 6')}")} AS confidence FROM (
      SELECT *, exp(-pow((radius_m + 1.5 * spread) / 250 - 5, 2) / (2 * 2.2 * 2.2)) AS eta_alignment FROM (
        SELECT m.*, spread, weight * (0.30 + 0.70 * {c('unique_drivers / greatest(weight, 1)')}) AS adjusted, {c('65 + 0.8 * spread', '60', '120')} AS radius_m,
          coalesce(i.value, 0) AS history, coalesce(s.value, 0) AS slot, coalesce(d.value, 0) AS density
        FROM micro_cells m JOIN (SELECT p.zone_id, gx, gy, avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) AS spread FROM recent_points p JOIN micro_cells k
            ON k.zone_id = p.zone_id AND k.gx = floor(x / 90) AND k.gy = floor(y / 90) GROUP BY 1, 2, 3) q USING (zone_id, gx, gy)
        LEFT JOIN side_history i USING (zone_id) LEFT JOIN side_slot s USING (zone_id) LEFT JOIN side_density d USING (zone_id))))""",
     "micro_cells", "recent_points", "side_history", "side_slot", "side_density")
view("anchors", f"""
  SELECT *, CASE WHEN same AND delta = 0 THEN 1.00 WHEN same AND delta = 1 THEN 0.80 WHEN same AND delta = 2 THEN 0.65 WHEN delta = 0 THEN 0.55 ELSE 0.35 END::DOUBLE AS weight
  FROM (SELECT *, isodow(make_timestamp(created_at * 1000000)) = isodow(make_timestamp({NOW}::BIGINT * 1000000)) AS same, abs(created_at % 86400 // 1200 - {NOW} % 86400 // 1200) AS delta FROM zone_points)""", "zone_points")
view("grid_cells", """
  SELECT zone_id, gx, gy, min_x + (gx + 0.5) * 135.0 AS cx, min_y + (gy + 0.5) * 135.0 AS cy FROM shapes, range(0, 40) a(gx), range(0, 40) b(gy)
  WHERE gx < greatest(ceil((max_x - min_x) / 135.0), 1) AND gy < greatest(ceil((max_y - min_y) / 135.0), 1) AND min_x + (gx + 0.5) * 135.0 < max_x AND min_y + (gy + 0.5) * 135.0 < max_y""", "shapes")
view("dense", """
  SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY zone_id) AS peak FROM (
    SELECT g.zone_id, gx, gy, cx, cy, round(sum(weight * exp(-(pow(cx - x, 2) + pow(cy - y, 2)) / (2 * 165.0 * 165.0))), 9) AS score
    FROM grid_cells g JOIN anchors p ON p.zone_id = g.zone_id AND pow(cx - x, 2) + pow(cy - y, 2) <= 280.0 * 280.0 GROUP BY ALL)) WHERE score > 0 AND score >= CAST(0.44 AS DOUBLE) * peak""", "grid_cells", "anchors")
view("components", """
  WITH RECURSIVE reach AS (
    SELECT zone_id, gx, gy, gx AS rx, gy AS ry FROM dense
    UNION SELECT r.zone_id, r.gx, r.gy, d.gx, d.gy FROM reach r JOIN dense d ON d.zone_id = r.zone_id AND abs(d.gx - r.rx) <= 1 AND abs(d.gy - r.ry) <= 1)
  SELECT d.*, component FROM dense d JOIN (SELECT zone_id, gx, gy, arg_min(rx || '_' || ry, (rx, ry)) AS component FROM reach GROUP BY 1, 2, 3) USING (zone_id, gx, gy)""", "dense")
view("component_rows", """
  SELECT *, CAST(row_number() OVER (PARTITION BY zone_id ORDER BY component_score DESC, support_weight DESC, support_points DESC, component) - 1 AS INTEGER) AS anchor_rank FROM (
    SELECT k.*, coalesce(support_weight, 0) AS support_weight, coalesce(support_points, 0) AS support_points FROM (
      SELECT zone_id, component, round(sum(score), 9) AS component_score, max(score) AS peak_score, count(*) AS cells, avg(cx) AS centroid_x, avg(cy) AS centroid_y FROM components GROUP BY 1, 2) k
    LEFT JOIN (SELECT zone_id, component, round(sum(weight), 9) AS support_weight, count(*) AS support_points FROM (
      SELECT DISTINCT p.zone_id, k.component, p.event_id, p.weight FROM anchors p JOIN components k ON k.zone_id = p.zone_id
        AND pow(greatest(abs(x - cx) - 62.1, 0), 2) + pow(greatest(abs(y - cy) - 62.1, 0), 2) <= 43.875 * 43.875) GROUP BY 1, 2) s USING (zone_id, component))""", "components", "anchors")
view("drift", """
  SELECT k.zone_id, k.component, component_score, centroid_x, centroid_y, sum(wr) AS total, coalesce(sum(x * wr) / sum(wr) - centroid_x, 0) AS dx, coalesce(sum(y * wr) / sum(wr) - centroid_y, 0) AS dy
  FROM component_rows k LEFT JOIN (
    SELECT p.zone_id, component, x, y, greatest(1 - greatest((1736164800 - created_at) / 60.0, 0) / 90, 0.05) * greatest(1 - sqrt(pow(x - centroid_x, 2) + pow(y - centroid_y, 2)) / 380, 0.1) AS wr
    FROM recent_points p JOIN component_rows r ON r.zone_id = p.zone_id WHERE sqrt(pow(x - centroid_x, 2) + pow(y - centroid_y, 2)) <= 380) q ON q.zone_id = k.zone_id AND q.component = k.component
  GROUP BY k.zone_id, k.component, component_score, centroid_x, centroid_y""", "component_rows", "recent_points")


def _to(side: str) -> str:
    """Distance of a recent point to the square of one side."""
    return f"sqrt(pow(greatest({side}.min_x - x, x - {side}.max_x, 0), 2) + pow(greatest({side}.min_y - y, y - {side}.max_y, 0), 2))"


view("merge_zones", """
  SELECT s.*, component_score, support_weight, centroid_x, centroid_y, CASE WHEN (s.zone_id - 118) // 5 % 2 = 0 THEN 'north' ELSE 'south' END AS side,
    (SELECT count(*) FROM recent_points p WHERE p.zone_id = s.zone_id) AS recent FROM shapes s JOIN component_rows k ON k.zone_id = s.zone_id AND anchor_rank = 0""", "shapes", "component_rows", "recent_points")
_MIX = f"(0.62 * {c('component_score / 9')} + 0.38 * {c('support_weight / 14')})"
_APART = "sqrt(pow(x2 - x{0}, 2) + pow(y2 - y{0}, 2))"


def statements() -> dict[str, str]:
    gated = "greatest(raw, 0) * confidence"
    overlap = "least(a.max_x, b.max_x) > greatest(a.min_x, b.min_x) AND least(a.max_y, b.max_y) > greatest(a.min_y, b.min_y)"
    return {
        "recency_weight": statement("SELECT zone_id, w AS weight, count(*) AS points FROM zone_points GROUP BY 1, 2", "zone_points"),
        "live_zone_score": statement(f"""
          SELECT zone_id, unique_drivers, {r6('wtc')} AS weighted_trip_count, {r6(c('smoothed'))} AS final_score, {r6('confidence')} AS confidence, {r6('live_n')} AS live_strength, {r6('sat')} AS density_penalty,
            (hist_n >= 0.24 OR (live_n >= 0.15 AND slot_n >= 0.12)) AND confidence >= 0.36 AND smoothed >= 0.18 AS recommended
          FROM (SELECT *, 0.72 * coalesce(previous, {gated}) + 0.28 * {gated} AS smoothed FROM (
            SELECT *, 0.55 * hist_n + 0.20 * live_n + 0.15 * slot_n + 0.10 * {c("0.55 * active + 0.45 * live_n")} - 0.18 * sat AS raw, {c('0.30 + 0.60 * hist_n + 0.20 * live_n - 0.10 * sat')} AS confidence FROM (
              SELECT *, {c('history / 52')} AS hist_n, {c('wtc / 12')} AS live_n, {c('slot / 28')} AS slot_n, {c('density / 5')} AS sat,
                {c(f"(SELECT count(DISTINCT user_id) FROM heartbeats WHERE seen_at >= {NOW} - 300) / 90.0")} AS active FROM (
                SELECT *, weighted * CASE WHEN weighted > 0 THEN 0.32 + 0.68 * {c('unique_drivers / greatest(weighted, 1)')} ELSE 0 END AS wtc FROM zone_live))))""", "zone_live", "heartbeats"),
        "micro_hotspots": statement(f"""
          SELECT zone_id, 'z' || zone_id || '_' || gx || '_' || gy AS cluster_id, CAST(position AS INTEGER) AS position, unique_drivers, events, tier = 0 AS recommended,
            {rounded(['center_lat', 'center_lng', 'radius_m', 'confidence', 'eta_alignment', 'final_score'])}, {r6('adjusted')} AS weighted_trip_count FROM (
            SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY final_score DESC, gx, gy) AS position FROM (
              SELECT *, min(tier) OVER (PARTITION BY zone_id) AS best FROM (
                SELECT *, CASE WHEN adjusted >= 0.85 AND confidence >= 0.18 AND final_score >= 0.10 THEN 0 WHEN events >= 2 AND confidence >= 0.08 AND final_score >= 0.03 THEN 1 END AS tier FROM micro_scored)) WHERE tier = best) WHERE position <= 3""", "micro_scored"),
        "timeslot_anchor_points": statement(f"SELECT event_id, zone_id, weight, {rounded(['x', 'y'], 3)} FROM anchors", "anchors"),
        "kde_cells": statement(f"SELECT zone_id, gx, gy, {rounded(['score', 'peak'])} FROM dense", "dense"),
        "hotspot_components": statement(f"SELECT zone_id, component, cells, support_points, anchor_rank, {rounded(['component_score', 'peak_score', 'support_weight'])}, {rounded(['centroid_x', 'centroid_y'], 3)} FROM component_rows", "component_rows"),
        "hotspot_limit": statement(f"""
          SELECT zone_id, n AS components, {r6('area')} AS area_sq_miles,
            CASE WHEN n >= 3 AND area >= 2.25 AND support >= 36 AND s2 / greatest(s0, 0.001) >= 0.42 AND w2 >= 10 AND least({_APART.format(0)}, {_APART.format(1)}) / 1609.344 >= 0.35 THEN 3 ELSE 2 END AS hotspot_limit
          FROM (SELECT k.zone_id, count(*) AS n, sum(support_weight) AS support, any_value((max_x - min_x) * (max_y - min_y)) / 2589988.11 AS area,
              max(component_score) FILTER (anchor_rank = 0) AS s0, max(component_score) FILTER (anchor_rank = 2) AS s2, max(support_weight) FILTER (anchor_rank = 2) AS w2,
              {', '.join(f'max(centroid_{a}) FILTER (anchor_rank = {i}) AS {a}{i}' for i in (0, 1, 2) for a in 'xy')}
            FROM component_rows k JOIN shapes s ON s.zone_id = k.zone_id GROUP BY 1)""", "component_rows", "shapes"),
        "recent_drift": statement(f"""
          SELECT zone_id, component, {rounded(['recent_strength', 'intensity'])}, {r6('degrees(2 * atan(exp(ny / 6378137.0)) - 1.5707963267948966::DOUBLE)')} AS lat, {r6('degrees(nx / 6378137.0)')} AS lng FROM (
            SELECT *, centroid_x + dx * k AS nx, centroid_y + dy * k AS ny, {c("0.28 + 0.58 * (0.75 * " + c('component_score / 10') + " + 0.25 * recent_strength)")} AS intensity FROM (
              SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) > 180 THEN 180 / sqrt(dx * dx + dy * dy) ELSE 1 END AS k, least(1, coalesce(total, 0) / 8) AS recent_strength FROM drift))""", "drift"),
        "emittable_intensity": statement(f"SELECT zone_id, component, {r6(c(f'0.24 + 0.52 * {_MIX}', '0.20', '0.90'))} AS intensity, {r6(c(f'0.34 + 0.56 * {_MIX}', '0.28', '0.95'))} AS confidence FROM component_rows", "component_rows"),
        "adjacent_hotspot_merge": statement(f"""
          SELECT za AS zone_id_a, zb AS zone_id_b, borough_name, reason, reason = 'eligible' AS eligible, band_points, {rounded(['centroid_miles', 'merged_score'])} FROM (
            SELECT *, CASE WHEN boundary > 60 THEN 'zone_boundary_too_far' WHEN centroid_miles > 0.40 THEN 'centroids_too_far' WHEN band_points < 3 THEN 'weak_boundary_activity' WHEN recents < 5 THEN 'insufficient_recent_points'
                WHEN supports < 14 THEN 'insufficient_historical_support' WHEN merged_score < 1.05 * top THEN 'merged_score_not_stronger' ELSE 'eligible' END AS reason FROM (
              SELECT *, CASE WHEN boundary <= 60 AND centroid_miles <= 0.40 THEN band ELSE 0 END AS band_points FROM (
                SELECT a.zone_id AS za, b.zone_id AS zb, a.side AS borough_name, sqrt(pow(a.centroid_x - b.centroid_x, 2) + pow(a.centroid_y - b.centroid_y, 2)) / 1609.344 AS centroid_miles,
                  sqrt(pow(greatest(a.min_x - b.max_x, b.min_x - a.max_x, 0), 2) + pow(greatest(a.min_y - b.max_y, b.min_y - a.max_y, 0), 2)) AS boundary,
                  a.recent + b.recent AS recents, a.support_weight + b.support_weight AS supports, a.component_score + b.component_score AS merged_score, greatest(a.component_score, b.component_score) AS top,
                  (SELECT count(*) FROM recent_points p WHERE p.zone_id IN (a.zone_id, b.zone_id) AND {_to('a')} <= 75 AND {_to('b')} <= 75) AS band
                FROM merge_zones a JOIN merge_zones b ON a.side = b.side AND a.zone_id < b.zone_id)))""", "merge_zones", "recent_points"),
        "quality_modifier": statement(f"""
          SELECT zone_id, bin_local_epoch, {r6(c("1 - 0.18 * short_trip_share - CASE WHEN borough_name = 'Manhattan' THEN 0.20 ELSE 0.14 END * market_saturation_n + 0.10 * downstream_n", '0.72', '1.18'))} AS quality_modifier FROM scored""", "scored"),
        "point_to_zone": statement(f"""
          SELECT event_id, z AS containing_zone_id, n.zone_id AS nearest_zone_id, coalesce(z, n.zone_id) AS current_zone_id, {r6('n.miles')} AS nearest_miles FROM (
            SELECT event_id, (SELECT min(s.zone_id) FROM shapes s WHERE abs(p.lng - s.centroid_longitude) < half AND abs(p.lat - s.centroid_latitude) < half) AS z,
              (SELECT min({{'miles': {haversine('p.lat', 'p.lng', 's.centroid_latitude', 's.centroid_longitude')}, 'zone_id': s.zone_id}}) FROM shapes s) AS n FROM zone_points p)""", "shapes", "zone_points"),
        "haversine_miles": statement(f"SELECT event_id, e.zone_id, {r6(haversine('lat', 'lng', 'centroid_latitude', 'centroid_longitude'))} AS miles FROM user_events e JOIN zones z ON z.zone_id = e.zone_id", "user_events", "zones"),
        "web_mercator": statement(f"SELECT event_id, {r6(X.format('lng'), 3)} AS x, {r6(Y.format('lat'), 3)} AS y FROM heartbeats", "heartbeats"),
        "experiment_bin_log": statement("""
          SELECT 'zone' AS kind, bin_local_epoch AS bin_time, CAST(zone_id AS BIGINT) AS row_id, CAST(n AS INTEGER) AS log_position FROM (SELECT *, row_number() OVER (PARTITION BY bin_local_epoch ORDER BY score_citywide_v3 DESC, zone_id) AS n FROM scored) WHERE n <= 32
          UNION ALL SELECT 'micro', bin_time, bin_id, CAST(n AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY bin_time ORDER BY final_score DESC, bin_id) AS n FROM experiment_bins) WHERE n <= 3""", "scored", "experiment_bins"),
    }
