"""DuckDB statements for the streaming jobs: what a batch over the same rows gives, cut at the
watermark where a job emits only complete results."""

from __future__ import annotations

from oracle.base import VIEWS, rounded, statement, view
from oracle import drivers, outcomes  # noqa: F401

view("last_event", "SELECT max(seen_at) AS m FROM user_events", "user_events")
view("dedup_first", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at) AS n FROM subscription_events) WHERE n = 1", "subscription_events")

# Daily totals of the heartbeats before the watermark: the same views over fewer rows.
view("beats_done", "SELECT * FROM heartbeats WHERE seen_at < (SELECT max(seen_at) FROM heartbeats) - 600", "heartbeats")
_DONE = {"heartbeats": "beats_done", "segments": "segments_done", "split": "split_done"}
for _name in ("segments", "split", "driver_days"):
    _needs, _sql = VIEWS[_name]
    for _old, _new in _DONE.items():
        _sql = _sql.replace(f"FROM {_old}", f"FROM {_new}")
    view(f"{_name}_done", _sql, *[_DONE.get(n, n) for n in _needs])
view("guard_end", "SELECT greatest((SELECT max(seen_at) FROM heartbeats), (SELECT max(voided_at) FROM pickups)) - 600 AS m", "heartbeats", "pickups")


def statements() -> dict[str, str]:
    return {
        "stream_zone_demand": statement("""
          SELECT seen_at // 1200 * 1200 AS bin_epoch, zone_id, count(*) AS pickups FROM user_events WHERE event_type = 'purchase'
          GROUP BY 1, 2 HAVING bin_epoch + 1200 <= (SELECT max(seen_at) FROM user_events WHERE event_type = 'purchase') - 600""", "user_events"),
        "stream_sessions": statement("""
          SELECT user_id, started_at, ended_at, heartbeats FROM (
            SELECT user_id, s, min(seen_at) AS started_at, max(seen_at) AS ended_at, count(*) AS heartbeats FROM (
              SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY seen_at, event_id) AS s FROM (
                SELECT *, CASE WHEN seen_at - lag(seen_at) OVER (PARTITION BY user_id ORDER BY seen_at, event_id) > 480 THEN 1 ELSE 0 END AS b FROM user_events)) GROUP BY 1, 2)
          WHERE ended_at + 480 <= (SELECT m FROM last_event) - 600""", "user_events", "last_event"),
        "stream_presence": statement(f"""
          SELECT user_id, kind, seen_at, {rounded(['lat', 'lng'])} FROM (
            SELECT *, unnest(CASE WHEN coalesce(after > seen_at + 300, TRUE) AND seen_at + 300 < (SELECT m FROM last_event) - 60 THEN ['item', 'stale'] ELSE ['item'] END) AS kind FROM (
              SELECT *, lead(seen_at) OVER (PARTITION BY user_id ORDER BY seen_at, event_id) AS after FROM user_events)) WHERE seen_at < (SELECT m FROM last_event) - 60""", "user_events", "last_event"),
        "stream_daily_stats": statement(f"""
          SELECT user_id, CAST(nyc_date AS VARCHAR) AS nyc_date, {rounded(['miles_worked', 'hours_worked'])}, heartbeat_count FROM driver_days_done WHERE heartbeat_count > 0 OR miles_worked > 0""", "driver_days_done"),
        "stream_pickup_guard": statement("""
          SELECT user_id, event_id, t AS tried_at, decision, decision IN ('driving_evidence', 'relocated_from_previous_session', 'relocated_from_last_accepted_trip') AS ok FROM guard_walk WHERE kind = 1 AND t < (SELECT m FROM guard_end)""", "guard_walk", "guard_end"),
        "stream_outcome_settlement": statement("""
          SELECT r.user_id, r.zone_id, r.recommendation_id, recommended_at, pickup_id, c.settled_at AS picked_up_at, minutes_to_trip, distance_miles, pickup_id IS NOT NULL AS converted_to_trip
          FROM recommendations r LEFT JOIN hotspot_claims c ON c.recommendation_id = r.recommendation_id, (SELECT max(seen_at) - 600 AS m FROM user_events WHERE event_type IN ('view', 'purchase'))
          WHERE c.settled_at < m OR (c.settled_at IS NULL AND recommended_at + 5400 < m)""", "recommendations", "hotspot_claims", "user_events"),
        "stream_event_dedup": statement("""
          SELECT user_key, event_id, occurred_at, received_at FROM (
            SELECT coalesce(subscription_id, 'none') AS user_key, event_id, occurred_at, received_at, max(occurred_at) OVER (PARTITION BY coalesce(subscription_id, 'none') ORDER BY received_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM dedup_first)
          WHERE newest IS NULL OR occurred_at > newest""", "dedup_first"),
        "stream_expiry": statement("""
          SELECT event_id AS item_id, seen_at AS created_at, seen_at + 1800 AS expired_at FROM user_events
          WHERE (event_type = 'purchase' OR (event_type = 'view' AND event_id % 3 <> 0))
            AND seen_at + 1800 < (SELECT max(seen_at + CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN 600 ELSE 0 END) FROM user_events WHERE event_type IN ('view', 'purchase')) - 600""", "user_events"),
    }
