"""DuckDB views of the input tables and a helper that composes them into one statement.

The views are written from the definitions in FIXTURES.md, apart from the Spark code.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}
#: Views read more than once by their successors.
KEPT: set[str] = set()


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (needs, sql)


def statement(body: str, *needs: str) -> str:
    """``WITH`` the needed views (in dependency order) followed by ``body``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        visit(need)
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' * (n in KEPT)}({VIEWS[n][1]})" for n in ordered)
    return f"WITH {ctes}\n{body}" if ctes else body


NOW = 1736164800

view("trips", """
  SELECT CAST(s_nationkey + 118 AS INTEGER) AS PULocationID,
    CAST(CASE WHEN l_orderkey % 50 = 0 THEN NULL WHEN l_partkey % 23 = 0 THEN 265 ELSE c_nationkey + 118 END AS INTEGER) AS DOLocationID,
    pickup_epoch, pickup_epoch - (l_suppkey % 9 - 1) * 60 AS request_epoch,
    CASE WHEN l_orderkey % 97 <> 0 THEN (floor(l_extendedprice * 100 + 0.5) % 6000) / 100.0 END AS driver_pay,
    CAST(240 + (l_partkey * 17) % 2400 AS DOUBLE) AS trip_time,
    l_quantity * CAST(0.3 AS DOUBLE) AS trip_miles,
    CASE WHEN l_linenumber % 7 = 0 THEN 1 ELSE 0 END AS shared_match_flag,
    CASE WHEN l_partkey % 29 = 0 THEN CAST(2.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS airport_fee
  FROM (SELECT *, 1736139600 + (datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 7) * 86400
               + ((l_orderkey * 37 + l_linenumber * 211 + l_partkey * 13) % 1440) * 60 AS pickup_epoch
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)""")
view("zones", """
  SELECT CAST(n_nationkey + 118 AS INTEGER) AS zone_id, n_name AS zone_name,
    CASE n_regionkey WHEN 0 THEN 'Manhattan' WHEN 1 THEN 'Bronx' WHEN 2 THEN 'Queens' WHEN 3 THEN 'Brooklyn' ELSE 'Staten Island' END AS borough_name,
    CAST(0.2 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (n_nationkey % 7) AS zone_area_sq_miles,
    CAST(40.60 AS DOUBLE) + CAST(0.012 AS DOUBLE) * n_nationkey AS centroid_latitude,
    CAST(-73.98 AS DOUBLE) + CAST(0.008 AS DOUBLE) * (n_nationkey % 5) AS centroid_longitude,
    n_nationkey + 118 IN (1, 132, 138) AS airport_excluded
  FROM nation""")
view("user_events", """
  SELECT event_id, user_id, event_type, value,
    1736143200 + CAST(floor((epoch_us(ts) - 1704067200000000) / 120e6) AS BIGINT) AS seen_at,
    CAST(40.70 AS DOUBLE) + CAST(event_id * 37 % 1000 AS DOUBLE) / 50000 AS lat,
    CAST(-73.98 AS DOUBLE) + CAST(event_id * 91 % 1000 AS DOUBLE) / 50000 AS lng,
    CAST(40.70 AS DOUBLE) + CAST((event_id + 1) * 37 % 1000 AS DOUBLE) / 50000 AS next_lat,
    CAST(-73.98 AS DOUBLE) + CAST((event_id + 1) * 91 % 1000 AS DOUBLE) / 50000 AS next_lng,
    CAST(118 + user_id % 25 AS INTEGER) AS zone_id
  FROM events""")
view("heartbeats", "SELECT event_id, user_id, seen_at, lat, lng FROM user_events", "user_events")
view("pickups", """
  SELECT event_id AS pickup_id, user_id, zone_id, lat, lng, seen_at AS created_at, event_id % 11 = 0 AS is_voided,
    CASE WHEN event_id % 11 = 0 THEN seen_at + 1800 END AS voided_at, CASE WHEN event_id % 11 = 0 THEN 'admin' END AS void_reason,
    event_id % 7 <> 0 AS counted_for_stats
  FROM user_events WHERE event_type = 'purchase'""", "user_events")
view("recommendations", """
  SELECT event_id AS recommendation_id, user_id, zone_id, 'c' || (event_id % 6) AS cluster_id, seen_at AS recommended_at,
    next_lat AS center_lat, next_lng AS center_lng, value % 10 / 10.0 AS score, event_id % 9 / CAST(9 AS DOUBLE) AS confidence
  FROM user_events WHERE event_type = 'view'""", "user_events")
view("guidance", """
  SELECT event_id AS guidance_id, user_id, seen_at AS recommended_at,
    CASE event_id % 4 WHEN 0 THEN 'hold' WHEN 1 THEN 'micro_reposition' WHEN 2 THEN 'move_nearby' ELSE 'wait_dispatch' END AS action,
    zone_id AS source_zone_id,
    CASE WHEN event_id % 3 = 0 THEN zone_id WHEN event_id % 3 = 1 THEN zone_id + 1 END AS target_zone_id
  FROM user_events WHERE event_type = 'click'""", "user_events")
view("resolved_outcomes", """
  SELECT r.*, c AS converted_to_trip, CASE WHEN c THEN CAST(recommendation_id % 80 AS DOUBLE) END AS minutes_to_trip,
    CASE WHEN c THEN (recommendation_id % 40) / CAST(100 AS DOUBLE) END AS distance_miles
  FROM (SELECT *, CASE WHEN recommendation_id % 5 = 0 THEN NULL ELSE recommendation_id % 3 = 0 END AS c FROM recommendations) r""",
     "recommendations")
view("reports", """
  SELECT event_id AS report_id, user_id, zone_id, lat, lng,
    CASE event_id % 4 WHEN 0 THEN 'Police' WHEN 1 THEN 'police' ELSE 'hazard' END AS type, seen_at AS created_at
  FROM user_events WHERE event_type = 'error'""", "user_events")
view("users", f"""
  SELECT user_id, 'user' || user_id || '@example.com' AS email,
    CASE WHEN user_id % 5 <> 0 THEN 'Driver ' || user_id END AS display_name, user_id % 23 = 0 AS is_admin,
    CASE WHEN user_id % 13 = 0 THEN NULL ELSE user_id % 17 = 0 END AS is_disabled,
    user_id % 19 = 0 AS is_suspended, user_id % 10 = 0 AS ghost_mode,
    {NOW} - (user_id % 40) * 86400 AS created_at,
    CASE WHEN user_id % 3 <> 0 THEN {NOW} + (user_id % 15 - 7) * 86400 END AS trial_expires_at,
    CASE WHEN user_id % 6 = 0 THEN 'comp' ELSE CASE user_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'past_due' WHEN 3 THEN 'cancelled' ELSE 'none' END END AS subscription_status,
    CASE WHEN user_id % 4 <> 0 THEN {NOW} + (user_id % 21 - 10) * 86400 END AS subscription_current_period_end,
    CASE WHEN user_id % 6 = 0 AND user_id % 12 <> 0 THEN {NOW} + (user_id % 9 - 4) * 86400 END AS comp_expires_at,
    CASE WHEN user_id % 4 = 0 THEN 'grandfathered:' || (user_id % 3) WHEN user_id % 6 = 0 THEN 'support' END AS comp_reason
  FROM (SELECT DISTINCT user_id FROM events)""")
view("daily_stats", """
  SELECT o_custkey AS user_id,
    DATE '2025-01-01' + CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 365 AS INTEGER) AS nyc_date,
    CAST(sum(CAST(floor(o_totalprice + 0.5) AS BIGINT) % 200) AS BIGINT) AS miles_worked,
    CAST(sum(o_orderkey % 12) AS BIGINT) AS hours_worked, CAST(sum(o_orderkey % 40) AS BIGINT) AS pickups_recorded
  FROM orders GROUP BY 1, 2""")
view("drivers", f"""
  SELECT c_custkey AS user_id, 'user' || c_custkey || '@example.com' AS email,
    CASE WHEN c_custkey % 5 <> 0 THEN 'Driver ' || c_custkey END AS display_name,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 17 = 0 END AS is_disabled,
    c_custkey % 19 = 0 AS is_suspended, c_custkey % 10 = 0 AS ghost_mode,
    CASE WHEN c_custkey % 2 = 0 THEN 'sub_' || c_custkey END AS subscription_id, CASE WHEN c_custkey % 3 = 0 THEN 'ctm_' || c_custkey END AS customer_id,
    CASE WHEN c_custkey % 5 = 0 THEN 'trialing' END AS subscription_status,
    CASE WHEN c_custkey % 4 = 0 THEN {NOW} + c_custkey % 30 * 86400 END AS subscription_current_period_end,
    CASE WHEN c_custkey % 7 = 0 THEN {NOW} + c_custkey % 500 * 60 END AS subscription_updated_at
  FROM customer""")
view("battles", f"""
  SELECT o_orderkey AS battle_id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'miles' ELSE 'hours' END AS metric,
    CASE o_orderkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS period,
    o_custkey AS challenger_id, o_custkey + 1 + o_orderkey % 7 AS challenged_id,
    CASE o_orderkey // 3 % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'active' WHEN 2 THEN 'completed' ELSE 'declined' END AS status,
    DATE '2025-01-01' + CAST(o_orderkey % 300 AS INTEGER) AS start_date,
    DATE '2025-01-01' + CAST(o_orderkey % 300 + CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 6 ELSE 29 END AS INTEGER) AS end_date,
    {NOW} - (o_orderkey % 72) * 3600 AS created_at, {NOW} - (o_orderkey % 72) * 3600 + 86400 AS expires_at,
    {NOW} + (o_orderkey % 9 - 4) * 3600 AS ends_at, o_orderkey % 5 AS challenger_start, o_orderkey % 3 AS challenged_start
  FROM orders""")
view("matches", f"""
  SELECT o_orderkey AS match_id, o_custkey AS player_one_id, o_custkey + 1 + o_orderkey % 5 AS player_two_id,
    CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 1 + o_orderkey % 5 END AS winner_id,
    CASE WHEN o_orderkey % 4 = 0 THEN 'billiards' ELSE 'dominoes' END AS game_type,
    {NOW} - o_orderkey % 5000 * 60 AS completed_at,
    CASE WHEN o_orderkey % 17 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 + o_orderkey % 5 ELSE o_custkey END END AS loser_id,
    CASE o_orderkey % 10 WHEN 0 THEN 'active' WHEN 1 THEN 'forfeited' ELSE 'completed' END AS status,
    CASE WHEN o_orderkey % 13 <> 0 THEN 60 - o_orderkey % 2 * 15 END AS winner_xp_awarded, o_orderkey % 5 * 2 AS loser_xp_awarded
  FROM orders""")
view("room_messages", """
  SELECT conv_id * 1000 + turn AS message_id, CASE WHEN conv_id % 3 = 0 THEN 'global' ELSE 'room' || (conv_id % 5) END AS room,
    CASE WHEN role = 'user' THEN conv_id % 15 ELSE (conv_id + 7) % 15 END AS user_id, text AS message,
    1736121600 + turn * 60 - conv_id % 20 * 86400 AS created_at,
    CASE WHEN turn % 4 = 3 THEN 'image' WHEN turn % 9 = 8 THEN 'voice' ELSE 'text' END AS message_type,
    CASE WHEN turn % 4 = 3 THEN 'img/' || (conv_id * 1000 + turn) END AS image_path,
    CASE WHEN turn % 4 <> 3 AND turn % 9 = 8 THEN 'audio/' || (conv_id * 1000 + turn) END AS audio_path
  FROM conversations""")
view("private_messages", """
  SELECT conv_id * 1000 + turn AS message_id,
    CASE WHEN role = 'user' THEN conv_id % 15 ELSE (conv_id + 7) % 15 END AS sender_id,
    CASE WHEN role = 'user' THEN (conv_id + 7) % 15 ELSE conv_id % 15 END AS recipient_id, text,
    1736121600 + turn * 60 - conv_id % 50 * 86400 AS created_at,
    CASE WHEN turn % 2 = 0 THEN 1736139600 + turn * 60 END AS read_at,
    CASE WHEN turn % 4 = 3 THEN 'image' ELSE 'text' END AS message_type,
    CASE WHEN turn % 4 = 3 THEN 'img/' || (conv_id * 1000 + turn) END AS image_path,
    CAST(NULL AS VARCHAR) AS audio_path
  FROM conversations""")


def r6(expr: str, digits: int = 6) -> str:
    return f"round({expr} + CAST(2.5e-9 AS DOUBLE), {digits}) + CAST(0 AS DOUBLE)"


def rounded(columns: list[str] | tuple[str, ...], digits: int = 6) -> str:
    return ", ".join(f"{r6(c, digits)} AS {c}" for c in columns)


def even(expr: str, digits: int = 0) -> str:
    scale = 10 ** digits
    return f"round_even(round(({expr}) * {scale}, 7), 0) / CAST({scale} AS DOUBLE) + CAST(0 AS DOUBLE)"


view("experiment_bins", """
  SELECT event_id AS bin_id, seen_at // 1200 * 1200 AS bin_time, zone_id, 'c' || (event_id % 6) AS cluster_id, value % 10 / 10.0 AS final_score,
    event_id % 9 / CAST(9 AS DOUBLE) AS confidence, event_id % 3 = 0 AS recommended FROM user_events WHERE event_type = 'signup'""", "user_events")
view("guidance_inputs", f"""
  SELECT event_id, user_id, event_id * 13 % 100 AS rating, event_id * 17 % 100 AS next_rating, event_id % 10 / CAST(10 AS DOUBLE) AS continuation,
    event_id % 60 AS tripless_minutes, event_id * 7 % 40 AS stationary_minutes, event_id * 3 % 30 AS movement_minutes, event_id % 4 AS move_attempts,
    event_id % 3 AS trips_60m, event_id % 2 = 1 AS moved_since_trip, event_id % 11 / CAST(10 AS DOUBLE) AS dispatch_uncertainty,
    CASE WHEN event_id % 5 <> 0 THEN event_id * 29 % 100 END AS best_rating, event_id % 40 / CAST(10 AS DOUBLE) AS best_distance,
    CASE WHEN event_id % 7 <> 0 THEN CASE event_id % 4 WHEN 0 THEN 'hold' WHEN 1 THEN 'micro_reposition' WHEN 2 THEN 'move_nearby' ELSE 'wait_dispatch' END END AS last_action,
    {NOW} - event_id % 1200 AS last_move_at
  FROM user_events""", "user_events")
view("subscription_events", f"""
  SELECT 'evt_' || (o_orderkey - CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) AS event_id,
    CASE o_orderkey % 5 WHEN 0 THEN 'subscription.created' WHEN 1 THEN 'subscription.updated' WHEN 2 THEN 'subscription.canceled' WHEN 3 THEN 'transaction.completed' ELSE 'customer.created' END AS event_type,
    {NOW} + o_orderkey % 997 * 60 AS occurred_at, {NOW} + o_orderkey * 30 AS received_at,
    CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS own_id,
    CASE WHEN o_orderkey % 11 <> 0 THEN 'sub_' || o_custkey || CASE WHEN o_orderkey % 7 = 0 THEN 'b' ELSE '' END END AS subscription_id,
    CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 8 IN (1, 2, 3) THEN 'ctm_' || o_custkey END AS customer_id,
    CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 8 IN (1, 2, 3, 5, 6, 7) THEN 'ctm_' || o_custkey END AS customer_ref,
    CASE WHEN o_orderkey % 9 IN (0, 1, 2, 3, 6) OR (o_orderkey % 11 <> 0 AND o_orderkey % 8 = 6) THEN 'user' || o_custkey || '@example.com' END AS mail,
    CASE o_orderkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'past_due' ELSE 'trialing' END AS status,
    CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 10 IN (5, 7) THEN {NOW} + o_orderkey % 60 * 86400 END AS period_end
  FROM orders""")
