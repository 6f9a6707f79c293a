"""DuckDB statements for the outcome, trip report and guidance operators.

The one-to-one claims of I1 and I2 are walked pickup by pickup in a recursive statement.
"""

from __future__ import annotations

from oracle.base import NOW, even, r6, rounded, statement, view
from oracle.drivers import business, haversine

SINCE = NOW - 4 * 3600

view("live_pickups", "SELECT * FROM pickups WHERE NOT is_voided", "pickups")
view("pickup_days", f"SELECT user_id, {business('created_at')} AS d, count(*) AS c FROM pickups WHERE counted_for_stats GROUP BY 1, 2", "pickups")
view("resolved", "SELECT * FROM resolved_outcomes WHERE converted_to_trip IS NOT NULL", "resolved_outcomes")


def _claims(name: str, limit: float, fallback: bool) -> None:
    """Recursive walk: the n-th pickup of every (user, zone) in time order, with the claimed ids so far."""
    miles = haversine("p.lat", "p.lng", "r.center_lat", "r.center_lng")
    far = f"CASE WHEN {miles} <= {limit} THEN round({miles}, 9) END"
    order = f"{far} ASC NULLS LAST, recommended_at DESC, recommendation_id DESC"
    where = "TRUE" if fallback else f"{miles} <= {limit}"
    best = (f"(SELECT {{'id': recommendation_id, 'when_at': recommended_at, 'miles': CASE WHEN {miles} <= {limit} THEN {miles} END}} FROM recommendations r "
            f"WHERE r.user_id = p.user_id AND r.zone_id = p.zone_id AND r.recommended_at BETWEEN p.created_at - 5400 AND p.created_at AND {where} "
            f"AND NOT list_contains(w.claimed, r.recommendation_id) ORDER BY {order} LIMIT 1)")
    view(f"{name}_order", "SELECT *, row_number() OVER (PARTITION BY user_id, zone_id ORDER BY created_at, pickup_id) AS n FROM pickups", "pickups")
    view(name, f"""
      WITH RECURSIVE walk AS (
        SELECT DISTINCT user_id, zone_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS claimed, CAST(NULL AS BIGINT) AS pickup_id, CAST(NULL AS BIGINT) AS settled_at,
          CAST(NULL AS STRUCT(id BIGINT, when_at BIGINT, miles DOUBLE)) AS best FROM {name}_order
        UNION ALL
        SELECT user_id, zone_id, n, CASE WHEN best IS NULL THEN claimed ELSE list_append(claimed, best.id) END, pickup_id, created_at, best FROM (
          SELECT p.user_id, p.zone_id, p.n, w.claimed, p.pickup_id, p.created_at, {best} AS best
          FROM walk w JOIN {name}_order p ON p.user_id = w.user_id AND p.zone_id = w.zone_id AND p.n = w.n + 1))
      SELECT user_id, zone_id, pickup_id, best.id AS recommendation_id, settled_at, {r6("(settled_at - best.when_at) / CAST(60 AS DOUBLE)")} AS minutes_to_trip,
        {r6('best.miles')} AS distance_miles, best.miles IS NOT NULL AS spatial FROM walk WHERE best IS NOT NULL""", f"{name}_order", "recommendations")


_claims("hotspot_claims", 0.35, True)
_claims("micro_claims", 0.20, False)

# The guard as a walk over every user's heartbeats and attempts in time order.
view("guard_order", """
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, kind, event_id) AS n FROM (
    SELECT user_id, seen_at AS t, 0 AS kind, event_id, lat, lng, NULL AS voided_at FROM heartbeats UNION ALL SELECT user_id, created_at, 1, pickup_id, lat, lng, voided_at FROM pickups)""", "heartbeats", "pickups")
view("guard_walk", f"""
  WITH RECURSIVE walk AS (
    SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS t, 0 AS kind, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS decision,
      CAST(NULL AS BIGINT) AS last_at, CAST(NULL AS DOUBLE) AS last_lat, CAST(NULL AS DOUBLE) AS last_lng, CAST(NULL AS BIGINT) AS end_at, CAST(NULL AS DOUBLE) AS end_lat, CAST(NULL AS DOUBLE) AS end_lng,
      CAST(NULL AS BIGINT) AS move_start, CAST(NULL AS BIGINT) AS last_motion, CAST([] AS STRUCT(t BIGINT, lat DOUBLE, lng DOUBLE, voided BIGINT)[]) AS taken FROM guard_order
    UNION ALL
    SELECT user_id, n, t, kind, event_id, decision, CASE WHEN kind = 0 THEN t ELSE last_at END, CASE WHEN kind = 0 THEN lat ELSE last_lat END, CASE WHEN kind = 0 THEN lng ELSE last_lng END,
      CASE WHEN broke THEN last_at ELSE end_at END, CASE WHEN broke THEN last_lat ELSE end_lat END, CASE WHEN broke THEN last_lng ELSE end_lng END,
      CASE WHEN kind = 1 THEN move_start WHEN moved THEN coalesce(CASE WHEN NOT broke THEN move_start END, last_at) WHEN broke OR stale THEN NULL ELSE move_start END,
      CASE WHEN kind = 1 THEN last_motion WHEN moved THEN t WHEN broke OR stale THEN NULL ELSE last_motion END,
      CASE WHEN accepted THEN list_append(taken, {{'t': t, 'lat': lat, 'lng': lng, 'voided': voided_at}}) ELSE taken END
    FROM (SELECT *, coalesce(decision IN ('driving_evidence', 'relocated_from_previous_session', 'relocated_from_last_accepted_trip'), FALSE) AS accepted FROM (
      SELECT *, CASE WHEN kind = 0 THEN NULL WHEN t < acc_at + 600 THEN 'pickup_cooldown_active' WHEN t - move_start >= 360 AND t - last_motion <= 180 THEN 'driving_evidence'
          WHEN from_end >= 0.25 THEN 'relocated_from_previous_session' WHEN from_acc >= 0.25 THEN 'relocated_from_last_accepted_trip' WHEN from_acc <= 0.08 THEN 'pickup_same_position' ELSE 'pickup_needs_recent_driving' END AS decision FROM (
        SELECT *, {haversine('acc.lat', 'acc.lng', 'lat', 'lng')} AS from_acc, acc.t AS acc_at FROM (
        SELECT o.user_id, o.n, o.t, o.kind, o.event_id, o.lat, o.lng, o.voided_at, last_at, last_lat, last_lng, end_at, end_lat, end_lng, move_start, last_motion, taken,
          list_last(list_filter(taken, lambda x: x.voided IS NULL OR x.voided > o.t)) AS acc,
          coalesce(o.kind = 0 AND o.t - last_at > 480, FALSE) AS broke, coalesce(o.kind = 0 AND {haversine('last_lat', 'last_lng', 'o.lat', 'o.lng')} >= 0.05, FALSE) AS moved,
          coalesce(o.kind = 0 AND o.t - last_motion > 180, FALSE) AS stale, {haversine('end_lat', 'end_lng', 'o.lat', 'o.lng')} AS from_end
        FROM walk w JOIN guard_order o ON o.user_id = w.user_id AND o.n = w.n + 1)))))
  SELECT * FROM walk WHERE n > 0""", "guard_order")
view("bracket", """
  SELECT *, min(least(level, 0)) OVER (PARTITION BY user_id ORDER BY t, kind, event_id) AS lowest FROM (
    SELECT *, sum(CASE WHEN kind = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY t, kind, event_id) AS level FROM (
      SELECT user_id, recommended_at AS t, 0 AS kind, guidance_id AS event_id, action, source_zone_id, target_zone_id, NULL AS zone_id FROM guidance
      UNION ALL SELECT user_id, created_at, 1, pickup_id, NULL, NULL, NULL, zone_id FROM pickups))""", "guidance", "pickups")
view("guidance_settled", """
  SELECT p.user_id, p.event_id AS pickup_id, q.event_id AS guidance_id, q.action, p.t AS settled_at, (p.t - q.t) / CAST(60 AS DOUBLE) AS minutes_to_trip, p.zone_id, q.source_zone_id, q.target_zone_id
  FROM bracket p JOIN bracket q ON q.user_id = p.user_id AND q.kind = 0 AND p.kind = 1 AND q.level - q.lowest = p.level - p.lowest + 1 AND (q.t, q.kind, q.event_id) < (p.t, p.kind, p.event_id)
  WHERE coalesce((SELECT min(b.level - b.lowest) FROM bracket b WHERE b.user_id = p.user_id AND (b.t, b.kind, b.event_id) >= (q.t, q.kind, q.event_id) AND (b.t, b.kind, b.event_id) < (p.t, p.kind, p.event_id)), 0) >= q.level - q.lowest
    AND NOT EXISTS (SELECT 1 FROM bracket b WHERE b.user_id = p.user_id AND b.kind = 1 AND (b.t, b.kind, b.event_id) > (q.t, q.kind, q.event_id) AND (b.t, b.kind, b.event_id) < (p.t, p.kind, p.event_id) AND b.level - b.lowest = p.level - p.lowest)
    AND p.lowest = q.lowest""", "bracket")
_MOVE = "action IN ('move_nearby', 'micro_reposition')"
_REASON = f"""CASE WHEN {_MOVE} AND zone_id = target_zone_id THEN 'trip_after_move_target_zone_match' WHEN {_MOVE} AND zone_id <> source_zone_id THEN 'trip_after_move_detected'
  WHEN {_MOVE} THEN 'trip_without_material_move' WHEN zone_id = source_zone_id THEN 'trip_while_holding_zone' ELSE 'trip_after_hold_with_relocation' END"""
_COUNTS = """count(*) FILTER (converted_to_trip IS NULL) AS pending_rows, count(*) FILTER (converted_to_trip) AS converted_rows, count(*) FILTER (NOT converted_to_trip) AS not_converted_rows,
  count(*) FILTER (converted_to_trip IS NOT NULL) AS resolved_rows"""


def _ranking(keys: str) -> str:
    return statement(f"""
      SELECT {keys}, count(*) AS total_rows, {_COUNTS}, max(recommended_at) AS latest_recommended_at,
        {r6('avg(minutes_to_trip) FILTER (converted_to_trip)')} AS avg_minutes_converted, {r6('avg(distance_miles) FILTER (converted_to_trip)')} AS avg_miles_converted,
        {r6('count(*) FILTER (converted_to_trip) / CAST(count(*) FILTER (converted_to_trip IS NOT NULL) AS DOUBLE)')} AS conversion_rate
      FROM resolved_outcomes GROUP BY {keys} HAVING count(*) FILTER (converted_to_trip IS NOT NULL) >= 3
      ORDER BY count(*) FILTER (converted_to_trip) / CAST(count(*) FILTER (converted_to_trip IS NOT NULL) AS DOUBLE) DESC, resolved_rows DESC, latest_recommended_at DESC, {keys} LIMIT 100""", "resolved_outcomes")


def _bins(name: str, clusters: str) -> str:
    return f"""SELECT '{name}' AS table_name, count(*) AS total_rows, count(*) FILTER (bin_time >= {SINCE}) AS recent_rows, count(*) FILTER (bin_time >= {SINCE} AND recommended) AS recommended_rows,
      count(DISTINCT zone_id) FILTER (bin_time >= {SINCE}) AS distinct_zones, {clusters} AS distinct_clusters, NULL::BIGINT AS pending_rows, NULL::BIGINT AS converted_rows, NULL::BIGINT AS not_converted_rows, NULL::BIGINT AS distinct_users,
      {r6(f'avg(final_score) FILTER (bin_time >= {SINCE})')} AS avg_final_score, {r6(f'avg(confidence) FILTER (bin_time >= {SINCE})')} AS avg_confidence,
      NULL::DOUBLE AS avg_minutes_converted, NULL::DOUBLE AS avg_miles_converted, NULL::DOUBLE AS conversion_rate FROM experiment_bins"""


def _outs(name: str) -> str:
    k = f"recommended_at >= {SINCE}"
    c, n = f"count(*) FILTER ({k} AND converted_to_trip)", f"count(*) FILTER ({k} AND NOT converted_to_trip)"
    return f"""SELECT '{name}', count(*), count(*) FILTER ({k}), NULL, count(DISTINCT zone_id) FILTER ({k}), count(DISTINCT cluster_id) FILTER ({k}), count(*) FILTER ({k} AND converted_to_trip IS NULL), {c}, {n},
      count(DISTINCT user_id) FILTER ({k}), NULL, NULL, {r6(f'avg(minutes_to_trip) FILTER ({k} AND converted_to_trip)')}, {r6(f'avg(distance_miles) FILTER ({k} AND converted_to_trip)')},
      {r6(f'{c} / CAST(nullif({c} + {n}, 0) AS DOUBLE)')} FROM resolved_outcomes"""


_W = f"CASE WHEN {NOW} - recommended_at <= 86400 THEN 1.00 WHEN {NOW} - recommended_at <= 259200 THEN 0.85 WHEN {NOW} - recommended_at <= 604800 THEN 0.65 ELSE 0.45 END::DOUBLE"
_UNTIL = "last_move_at + CASE last_action WHEN 'move_nearby' THEN 660 WHEN 'micro_reposition' THEN 420 END"


def _gate(expr: str, neutral: str) -> str:
    return r6(f"CASE WHEN sample_count >= 6 THEN {expr} ELSE {neutral} END")


view("timeline_positions", "SELECT bin_local_epoch, row_number() OVER (ORDER BY bin_local_epoch) - 1 AS pos FROM (SELECT DISTINCT bin_local_epoch FROM scored)", "scored")
view("outlook", """
  SELECT s.bin_local_epoch, s.zone_id, CAST(count(*) AS INTEGER) AS n_points,
    string_agg(f.bin_local_epoch || ':' || f.rating_citywide_v3 || ':' || f.bucket_citywide_v3 || ':' || f.rating_staten_island_v2, ',' ORDER BY f.bin_local_epoch) AS points
  FROM scored s JOIN timeline_positions a ON a.bin_local_epoch = s.bin_local_epoch JOIN timeline_positions b ON b.pos BETWEEN a.pos AND a.pos + 5
  JOIN scored f ON f.bin_local_epoch = b.bin_local_epoch AND f.zone_id = s.zone_id GROUP BY ALL""", "scored", "timeline_positions")


_OK = "decision IN ('driving_evidence', 'relocated_from_previous_session', 'relocated_from_last_accepted_trip')"
view("presence_now", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen_at DESC, event_id DESC) AS n FROM heartbeats) WHERE n = 1", "heartbeats")
_RATE = f"""SELECT user_id, count(*) AS total, avg(CAST(converted_to_trip AS INTEGER)) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY recommended_at DESC, recommendation_id DESC) AS n
  FROM resolved_outcomes WHERE converted_to_trip IS NOT NULL AND recommended_at >= {NOW} - 7200) WHERE n <= 25 GROUP BY 1"""
_SNAPSHOT = f"""
  SELECT user_id, {even('tripless', 2)} AS tripless_minutes, {even('still', 2)} AS stationary_minutes, {even('moving', 2)} AS movement_minutes, moved_since_trip, trips_30m, trips_60m, trips_120m, greatest(move_attempts, coalesce(CASE WHEN s_id AND user_id % 5 <> 0 THEN user_id % 4 END, 0)) AS move_attempts, CASE WHEN s_id THEN CASE user_id % 4 WHEN 0 THEN 'hold' WHEN 1 THEN 'micro_reposition' WHEN 2 THEN 'move_nearby' ELSE 'wait_dispatch' END END AS last_action,
    CASE WHEN s_id AND user_id % 2 = 0 THEN {NOW} + user_id % 600 END AS hold_until, {even('rate', 3)} AS recommendation_rate, {even('rate', 3)} AS micro_rate, presence_stale,
    least({even("0.2 + CASE WHEN tripless >= 25 THEN 0.2 ELSE 0 END + CASE WHEN tripless >= 45 THEN 0.2 ELSE 0 END + CASE WHEN total >= 4 AND rate < 0.25 THEN 0.30 ELSE 0 END + CASE WHEN trips_120m = 0 THEN 0.1 ELSE 0 END + CASE WHEN move_attempts >= 2 THEN 0.1 ELSE 0 END", 3)}, 1) AS dispatch_uncertainty
  FROM (SELECT p.user_id, greatest(0, ({NOW} - coalesce(t.created_at, g.move_start, g.last_motion, p.seen_at)) / CAST(60 AS DOUBLE)) AS tripless, coalesce(greatest(0, ({NOW} - g.last_motion) / CAST(60 AS DOUBLE)), 0) AS still,
      coalesce(greatest(0, ({NOW} - g.move_start) / CAST(60 AS DOUBLE)), 0) AS moving, coalesce({haversine('p.lat', 'p.lng', 't.lat', 't.lng')} >= 0.25, FALSE) AS moved_since_trip,
      coalesce(c30, 0) AS trips_30m, coalesce(c60, 0) AS trips_60m, coalesce(c120, 0) AS trips_120m, coalesce(a.attempts, 0) AS move_attempts, coalesce(r.rate, 0) AS rate, coalesce(r.total, 0) AS total, {NOW} - p.seen_at > 300 AS presence_stale, p.user_id % 3 <> 0 AS s_id
    FROM presence_now p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, pickup_id DESC) AS n FROM live_pickups) WHERE n = 1) t ON t.user_id = p.user_id
    LEFT JOIN (SELECT user_id, count(*) FILTER (created_at >= {NOW} - 1800) AS c30, count(*) FILTER (created_at >= {NOW} - 3600) AS c60, count(*) FILTER (created_at >= {NOW} - 7200) AS c120 FROM live_pickups GROUP BY 1) k ON k.user_id = p.user_id
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS m FROM guard_walk WHERE kind = 0) WHERE m = 1) g ON g.user_id = p.user_id
    LEFT JOIN ({_RATE}) r ON r.user_id = p.user_id
    LEFT JOIN (SELECT user_id, count(*) AS attempts FROM (
      SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY recommended_at DESC, guidance_id DESC) AS hits FROM (
        SELECT y.*, CASE WHEN s.guidance_id IS NOT NULL THEN 1 ELSE 0 END AS hit, row_number() OVER (PARTITION BY y.user_id ORDER BY y.recommended_at DESC, y.guidance_id DESC) AS n
        FROM guidance y LEFT JOIN guidance_settled s ON s.guidance_id = y.guidance_id WHERE y.recommended_at >= {NOW} - 5400)
      WHERE n <= 40 AND action IN ('move_nearby', 'micro_reposition')) WHERE hits = 0 GROUP BY 1) a ON a.user_id = p.user_id)"""


def statements() -> dict[str, str]:
    claims = "user_id, zone_id, pickup_id, recommendation_id, settled_at, minutes_to_trip, distance_miles"
    return {
        "settle_hotspot_outcomes": statement(f"SELECT {claims}, spatial FROM hotspot_claims", "hotspot_claims"),
        "settle_micro_outcomes": statement(f"SELECT {claims} FROM micro_claims", "micro_claims"),
        "settle_guidance_outcomes": statement(f"""
          SELECT user_id, pickup_id, guidance_id, action, settled_at, {rounded(['minutes_to_trip'])}, settlement_reason,
            settlement_reason IN ('trip_after_move_target_zone_match', 'trip_after_move_detected', 'trip_after_hold_with_relocation') AS moved_before_trip
          FROM (SELECT *, {_REASON} AS settlement_reason FROM guidance_settled)""", "guidance_settled"),
        "pickup_guard_state": statement("""
          SELECT user_id, t AS seen_at, event_id, end_at AS previous_session_end_at, move_start AS movement_streak_started_at, last_motion AS last_meaningful_motion_at FROM guard_walk WHERE kind = 0""", "guard_walk"),
        "pickup_guard_decision": statement(f"SELECT user_id, event_id, t AS tried_at, decision, {_OK} AS ok FROM guard_walk WHERE kind = 1", "guard_walk"),
        "activity_snapshot": statement(_SNAPSHOT, "presence_now", "guard_walk", "live_pickups", "resolved_outcomes", "guidance", "guidance_settled"),
        "outcome_modifier": statement(f"""
          SELECT zone_id, sample_count, {_gate('least(greatest(1 + (raw - 1) * support, 0.78), 1.22)', '1')} AS modifier, {_gate('support', '0')} AS support_strength, {_gate('rate', '0')} AS conversion_rate,
            {_gate('raw_rate', '0')} AS raw_conversion_rate, {_gate('med', '0')} AS median_minutes, {_gate('minutes', '0')} AS weighted_minutes, {_gate('miles', '0')} AS weighted_miles, {_gate('raw', '1')} AS raw_modifier
          FROM (SELECT *, 1 + (rate - 0.45) * 0.55 + (12 - minutes) / 50 + CASE WHEN nd > 0 THEN least(greatest((0.12 - miles) / 0.40, -0.08), 0.08) ELSE 0 END AS raw FROM (
            SELECT zone_id, count(*) AS sample_count, sum(CASE WHEN converted_to_trip THEN w ELSE 0 END) / greatest(sum(w), 0.0001) AS rate, count(*) FILTER (converted_to_trip) / CAST(count(*) AS DOUBLE) AS raw_rate,
              coalesce(median(minutes_to_trip), 15) AS med, coalesce(sum(w * minutes_to_trip) / sum(w) FILTER (minutes_to_trip IS NOT NULL), 15) AS minutes,
              coalesce(sum(w * greatest(distance_miles, 0)) FILTER (distance_miles IS NOT NULL) / sum(w) FILTER (distance_miles IS NOT NULL), 0) AS miles, count(distance_miles) AS nd,
              least(greatest((sum(w) - 4) / 6, 0), 1) AS support
            FROM (SELECT *, {_W} AS w FROM resolved) GROUP BY zone_id))""", "resolved"),
        "experiment_summary": statement(" UNION ALL ".join([
            _bins("hotspot_bins", "NULL::BIGINT"), _bins("micro_bins", f"count(DISTINCT cluster_id) FILTER (bin_time >= {SINCE})"), _outs("hotspot_outcomes"), _outs("micro_outcomes")]), "experiment_bins", "resolved_outcomes"),
        "zone_conversion_ranking": _ranking("zone_id"),
        "micro_conversion_ranking": _ranking("cluster_id, zone_id"),
        "outcome_listing": statement(f"""
          SELECT recommendation_id, user_id, zone_id, cluster_id, recommended_at, 'not_converted' AS outcome_status, {rounded(['score', 'confidence'])}
          FROM resolved_outcomes WHERE converted_to_trip = FALSE AND recommended_at >= {SINCE} ORDER BY recommended_at DESC, recommendation_id DESC LIMIT 200""", "resolved_outcomes"),
        "experiment_bin_listing": statement(f"""
          SELECT bin_id, bin_time, zone_id, cluster_id, recommended, {rounded(['final_score', 'confidence'])}
          FROM experiment_bins b WHERE recommended AND bin_time >= {SINCE} ORDER BY bin_time DESC, bin_id DESC LIMIT 200""", "experiment_bins"),
        "retention_prune": statement(f"""
          SELECT zone_id, count(*) AS kept, min(t) AS oldest FROM (SELECT zone_id, recommended_at - recommendation_id % 28 * 86400 AS t FROM resolved_outcomes) WHERE t >= {NOW} - 1209600 GROUP BY zone_id""", "resolved_outcomes"),
        "trips_summary": statement(f"""
          SELECT count(*) FILTER (NOT is_voided) AS total_recorded_trips, count(*) FILTER (NOT is_voided AND created_at >= {NOW} - 86400) AS trips_last_24h, count(*) FILTER (NOT is_voided AND created_at >= {NOW} - 604800) AS trips_last_7d,
            max(created_at) FILTER (NOT is_voided) AS latest_trip_at, count(DISTINCT user_id) FILTER (NOT is_voided) AS distinct_users, count(DISTINCT zone_id) FILTER (NOT is_voided) AS distinct_zones, count(*) FILTER (is_voided) AS voided_trips FROM pickups""", "pickups"),
        "recent_trips": statement(f"""
          SELECT pickup_id, p.user_id, display_name, zone_id, p.created_at, is_voided, voided_at, void_reason, {rounded(['lat', 'lng'])}
          FROM pickups p LEFT JOIN users u ON u.user_id = p.user_id ORDER BY p.created_at DESC, pickup_id DESC LIMIT 100""", "pickups", "users"),
        "void_reversal": statement(f"""
          SELECT user_id, CAST({business('created_at')} AS VARCHAR) AS nyc_date, count(*) AS recorded, count(*) FILTER (is_voided) AS reversed, greatest(count(*) - count(*) FILTER (is_voided), 0) AS pickups_recorded
          FROM pickups WHERE counted_for_stats GROUP BY 1, 2""", "pickups"),
        "guidance_action": statement(f"""
          SELECT event_id, user_id, until AS move_cooldown_until,
            CASE rule WHEN 2 THEN 'wait_dispatch' WHEN 3 THEN 'micro_reposition' WHEN 4 THEN 'move_nearby' WHEN 5 THEN 'wait_dispatch' WHEN 6 THEN 'wait_dispatch' ELSE 'hold' END AS action,
            CASE rule WHEN 1 THEN 0.75 WHEN 2 THEN 0.7 WHEN 3 THEN 0.62 WHEN 4 THEN 0.72 WHEN 5 THEN 0.67 WHEN 6 THEN 0.58 ELSE 0.55 END::DOUBLE AS confidence,
            CASE rule WHEN 1 THEN {NOW + 360} WHEN 2 THEN {NOW + 480} WHEN 3 THEN {NOW + 300} WHEN 5 THEN {NOW + 480} WHEN 6 THEN until END AS hold_until,
            CASE rule WHEN 1 THEN 'zone_still_strong,continuation_supportive,settling_window' WHEN 2 THEN 'recent_movement_no_conversion,dispatch_bottleneck_likely,avoid_repeat_reposition'
              WHEN 3 THEN 'stationary_too_long,zone_workable,no_clear_nearby_edge' WHEN 4 THEN 'current_zone_weak,nearby_materially_better,cooldown_clear'
              WHEN 5 THEN 'recent_moves_failed,dispatch_bottleneck_likely,avoid_bounce' WHEN 6 THEN 'move_cooldown_active,anti_spam' ELSE 'default_hold_bias' END AS reason_codes
          FROM (SELECT *, CASE
              WHEN rating >= 64 AND next_rating >= rating - 4 AND continuation >= 0.45 AND (tripless_minutes <= 18 OR movement_minutes <= 12) THEN 1
              WHEN rating >= 50 AND moved_since_trip AND move_attempts >= 1 AND dispatch_uncertainty >= 0.5 AND trips_60m <= 0 THEN 2
              WHEN rating >= 50 AND tripless_minutes >= 20 AND stationary_minutes >= 14 AND (best_rating IS NULL OR best_rating < rating + 10) THEN 3
              WHEN best_rating IS NOT NULL AND rating < 55 AND next_rating < 58 AND best_rating >= rating + 13 AND NOT coalesce({NOW} < until, FALSE) AND move_attempts < 3 AND best_distance <= 2.5 THEN 4
              WHEN move_attempts >= 2 AND trips_60m <= 0 AND dispatch_uncertainty >= 0.45 AND rating >= 48 THEN 5
              WHEN coalesce({NOW} < until, FALSE) THEN 6 ELSE 7 END AS rule FROM (SELECT *, {_UNTIL} AS until FROM guidance_inputs))""", "guidance_inputs"),
        "nearby_better_zone": statement(f"""
          SELECT user_id, CAST(n - 1 AS INTEGER) AS position, zone_id, rating, distance_miles FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, distance_miles, zone_id) AS n FROM (
              SELECT h.user_id, z.zone_id, s.rating_citywide_v3 AS rating, round({haversine('h.lat', 'h.lng', 'z.centroid_latitude', 'z.centroid_longitude')}, 6) AS distance_miles
              FROM (SELECT user_id, arg_max(lat, (seen_at, event_id)) AS lat, arg_max(lng, (seen_at, event_id)) AS lng FROM heartbeats GROUP BY 1) h, scored s JOIN zones z ON z.zone_id = s.zone_id
              WHERE s.bin_local_epoch = (SELECT max(bin_local_epoch) FROM scored)) WHERE distance_miles <= 2.5) WHERE n <= 3""", "heartbeats", "scored", "zones"),
        "pickup_xp_delta": statement(f"""
          SELECT pickup_id, user_id, xp_before, xp_after, xp_after - xp_before AS xp_awarded, CAST(lb AS INTEGER) AS level_before, CAST(la AS INTEGER) AS level_after, la > lb AS leveled_up FROM (
            SELECT *, (SELECT count(*) FROM levels WHERE xp <= xp_before) AS lb, (SELECT count(*) FROM levels WHERE xp <= xp_after) AS la FROM (
              SELECT pickup_id, p.user_id, CAST(coalesce(work_xp, 0) + 20 * (earlier + least(n - 1, 25)) AS BIGINT) AS xp_before, CAST(coalesce(work_xp, 0) + 20 * (earlier + least(n, 25)) AS BIGINT) AS xp_after
              FROM (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY created_at, pickup_id) AS n,
                      (SELECT coalesce(sum(least(c, 25)), 0) FROM pickup_days e WHERE e.user_id = q.user_id AND e.d < q.d) AS earlier
                    FROM (SELECT *, {business('created_at')} AS d FROM pickups WHERE counted_for_stats) q) p
              LEFT JOIN (SELECT user_id, sum({even('miles_worked * 8')} + {even('hours_worked * 30')}) AS work_xp FROM driver_days GROUP BY 1) w ON w.user_id = p.user_id))""",
            "pickups", "pickup_days", "driver_days", "levels"),
        "guidance_outlook": statement("SELECT * FROM outlook", "outlook"),
        "outlook_lookup": statement("SELECT * FROM outlook WHERE bin_local_epoch = (SELECT min(bin_local_epoch) FROM scored) AND zone_id IN (119, 120, 131, 999)", "outlook", "scored"),
    }



