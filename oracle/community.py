"""DuckDB statements for the presence, community and account operators."""

from __future__ import annotations

from oracle.base import KEPT, NOW, rounded, statement, view
from oracle.drivers import ACTIVE, BADGE, NAME

AGE = 900
view("presence", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen_at DESC, event_id DESC) AS n FROM heartbeats WHERE event_id % 60 <= 50) WHERE n = 1""", "heartbeats")
view("active", f"SELECT * FROM users WHERE {ACTIVE}", "users")
view("open_rooms", "SELECT * FROM room_messages WHERE user_id IN (SELECT user_id FROM active)", "room_messages", "active")
view("threads", f"""
  SELECT t.user_id, t.other_id, p.message_id, p.sender_id, p.created_at, CASE WHEN trim(coalesce(p.text, '')) <> '' THEN trim(p.text) WHEN p.message_type = 'voice' THEN '[Voice note]' ELSE '' END AS preview, unread_count, {NAME} AS other_name
  FROM (SELECT u AS user_id, o AS other_id, max(message_id) AS m, CAST(sum(unread) AS BIGINT) AS unread_count FROM (
      SELECT message_id, sender_id AS u, recipient_id AS o, 0 AS unread FROM private_messages UNION ALL SELECT message_id, recipient_id, sender_id, CASE WHEN read_at IS NULL THEN 1 ELSE 0 END FROM private_messages) GROUP BY 1, 2) t
  JOIN private_messages p ON p.message_id = t.m JOIN users d ON d.user_id = t.other_id""", "private_messages", "users")
view("expired_rows", f"""
  SELECT 'public' AS scope, message_id, audio_path, image_path FROM room_messages WHERE created_at < {NOW} - 7 * 86400
  UNION ALL SELECT 'private', message_id, audio_path, image_path FROM private_messages WHERE created_at < {NOW} - 30 * 86400""", "room_messages", "private_messages")
view("purge_users", "SELECT user_id FROM users WHERE user_id % 11 = 3", "users")
_IN = "IN (SELECT user_id FROM purge_users)"
view("work_states", "SELECT DISTINCT user_id FROM heartbeats", "heartbeats")
view("badges", f"SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY miles_worked DESC, user_id) AS n FROM daily_stats JOIN drivers USING (user_id) WHERE nyc_date = DATE '2025-06-18' AND {ACTIVE}) WHERE n <= 3", "daily_stats", "drivers")
for _copy, _of in (("presence_runtime_state", "presence"), ("pickup_guard_state", "work_states"), ("driver_work_state", "work_states")):
    view(_copy, f"SELECT * FROM {_of}", _of)
_PURGE = {**{t: f"user_id {_IN}" for t in ("presence", "presence_runtime_state", "pickup_guard_state", "driver_work_state", "badges")}, "room_messages": f"user_id {_IN}", "private_messages": f"sender_id {_IN} OR recipient_id {_IN}", "reports": f"user_id {_IN}",
          "pickups": f"user_id {_IN}", "daily_stats": f"user_id {_IN}", "users": f"user_id {_IN}"}
_REASON = f"""CASE WHEN email IS NULL THEN 'account_deleted' WHEN coalesce(is_disabled, FALSE) THEN 'disabled' WHEN is_suspended THEN 'suspended' WHEN ghost_mode THEN 'ghost_mode' WHEN seen_at < {NOW} - {AGE} THEN 'stale' END"""
view("sub_first", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at) AS n FROM subscription_events) WHERE n = 1", "subscription_events")
view("sub_known", "SELECT * FROM sub_first WHERE event_type <> 'customer.created'", "sub_first")
view("sub_own", "SELECT *, own_id AS user_id FROM sub_known WHERE own_id IN (SELECT user_id FROM drivers)", "sub_known", "drivers")
view("sub_rest", "SELECT e.*, d.user_id AS mail_user FROM sub_known e LEFT JOIN drivers d ON d.email = e.mail WHERE own_id IS NULL", "sub_known", "drivers")
#: Rounds written out; the Spark side goes on until nothing changes.
ROUNDS = 5


def _spans(name: str, k: int) -> str:
    """Who holds an id when: stored ones, replacements, and a transaction's where there was none."""
    return f"""(SELECT key, user_id AS holder, t AS since, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), 1000000000000) AS until FROM (
      SELECT user_id, -1 AS t, {name} AS key FROM drivers WHERE {name} IS NOT NULL
      UNION ALL SELECT user_id, received_at, {name} FROM sub_applied_{k} WHERE {name} IS NOT NULL AND event_type LIKE 'subscription.%'
      UNION ALL SELECT f.user_id, f.t, f.key FROM (SELECT user_id, min(received_at) AS t, arg_min({name}, received_at) AS key FROM sub_applied_{k} WHERE {name} IS NOT NULL AND event_type LIKE 'transaction.%' GROUP BY 1) f
        JOIN drivers d ON d.user_id = f.user_id AND d.{name} IS NULL
        LEFT JOIN (SELECT user_id, min(received_at) AS t FROM sub_applied_{k} WHERE {name} IS NOT NULL AND event_type LIKE 'subscription.%' GROUP BY 1) s ON s.user_id = f.user_id WHERE s.t IS NULL OR f.t < s.t))"""


for _k in range(ROUNDS):
    view(f"sub_resolved_{_k}", "SELECT * FROM sub_own" if _k == 0 else
         f"SELECT * FROM sub_own UNION ALL SELECT r.* EXCLUDE (mail_user), l.user_id FROM sub_rest r JOIN sub_links_{_k - 1} l ON l.event_id = r.event_id WHERE l.user_id IS NOT NULL",
         "sub_own", *([f"sub_links_{_k - 1}", "sub_rest"] if _k else []))
    view(f"sub_applied_{_k}", f"""
      SELECT * FROM (SELECT r.*, greatest(d.subscription_updated_at, max(occurred_at) OVER (PARTITION BY r.user_id ORDER BY received_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS newest
        FROM (SELECT *, event_type = 'transaction.completed' AND period_end IS NULL AND customer_id IS NULL AND subscription_id IS NULL AS idle FROM sub_resolved_{_k}) r JOIN drivers d ON d.user_id = r.user_id)
      WHERE newest IS NULL OR occurred_at > newest""".replace("max(occurred_at)", "max(CASE WHEN NOT idle THEN occurred_at END)"), f"sub_resolved_{_k}", "drivers")
    view(f"sub_links_{_k}", f"""
      SELECT r.event_id, coalesce(s.u, c.u, mail_user) AS user_id FROM sub_rest r
      LEFT JOIN (SELECT event_id, min(holder) AS u FROM sub_rest JOIN {_spans('subscription_id', _k)} ON key = subscription_id AND since < received_at AND received_at <= until GROUP BY 1) s ON s.event_id = r.event_id
      LEFT JOIN (SELECT event_id, min(holder) AS u FROM sub_rest JOIN {_spans('customer_id', _k)} ON key = customer_ref AND since < received_at AND received_at <= until GROUP BY 1) c ON c.event_id = r.event_id""",
         f"sub_applied_{_k}", "sub_rest", "drivers")
    KEPT.update({f"sub_resolved_{_k}", f"sub_applied_{_k}", f"sub_links_{_k}", "sub_rest", "sub_own"})
_STATUS = """CASE WHEN event_type IN ('subscription.created', 'subscription.updated') THEN status WHEN event_type = 'subscription.canceled' THEN 'cancelled' WHEN period_end IS NOT NULL THEN 'active' END"""


def _last(expr: str, fn: str = "arg_max") -> str:
    return f"{fn}({expr}, (received_at, event_id)) FILTER (({expr}) IS NOT NULL)"


def statements() -> dict[str, str]:
    sub = "event_type LIKE 'subscription.%'"
    days = "greatest(floor(({0} - " + str(NOW) + ") / CAST(86400 AS DOUBLE)), 0)::BIGINT"
    paid = f"(subscription_status IN ('active', 'past_due') AND coalesce(subscription_current_period_end > {NOW}, FALSE))"
    comp = f"(subscription_status = 'comp' AND (comp_expires_at IS NULL OR comp_expires_at > {NOW}))"
    trial = f"coalesce(trial_expires_at > {NOW}, FALSE)"
    kind = f"CASE WHEN is_admin THEN 'admin' WHEN {comp} THEN 'comp' WHEN {paid} THEN 'paid' WHEN {trial} THEN 'trial' ELSE 'none' END"
    return {
        "presence_latest": statement(f"SELECT user_id, event_id, seen_at, {rounded(['lat', 'lng'])} FROM presence", "presence"),
        "presence_viewport": statement(f"""
          SELECT p.user_id, {NAME} AS display_name, seen_at, {rounded(['lat', 'lng'])} FROM presence p JOIN users u ON u.user_id = p.user_id
          WHERE seen_at >= {NOW} - {AGE} AND lat BETWEEN 40.70 AND 40.72 AND lng BETWEEN -73.98 AND -73.96 AND {ACTIVE} AND NOT ghost_mode""", "presence", "users"),
        "presence_delta": statement(f"""
          SELECT user_id, CASE WHEN reason IS NULL THEN 'item' ELSE 'removed' END AS kind, reason, changed_at_ms, max(changed_at_ms) OVER () AS cursor FROM (
            SELECT p.user_id, {_REASON} AS reason, seen_at * 1000 AS changed_at_ms FROM presence p LEFT JOIN users u ON u.user_id = p.user_id
            WHERE seen_at * 1000 > CAST({NOW - 3600} AS BIGINT) * 1000)""", "presence", "users"),
        "presence_counts": statement(f"""
          SELECT count(*) AS online, count(*) FILTER (ghost_mode) AS ghosted, count(*) FILTER (({_REASON}) IS NULL) AS visible FROM presence p LEFT JOIN users u ON u.user_id = p.user_id WHERE seen_at >= {NOW} - {AGE}""", "presence", "users"),
        "live_drivers": statement(f"""
          SELECT p.user_id, display_name, seen_at, coalesce(ghost_mode, FALSE) AS ghost_mode, badge_code, {rounded(['lat', 'lng'])} FROM (SELECT * FROM presence ORDER BY seen_at DESC, user_id LIMIT 100) p LEFT JOIN users u ON u.user_id = p.user_id
          LEFT JOIN (SELECT user_id, {BADGE.format('n')} AS badge_code FROM (SELECT user_id, row_number() OVER (ORDER BY miles_worked DESC, user_id) AS n FROM daily_stats JOIN users USING (user_id) WHERE nyc_date = DATE '2025-06-18' AND {ACTIVE}) WHERE n <= 3) b ON b.user_id = p.user_id""", "presence", "users", "daily_stats"),
        "active_users": statement("SELECT user_id, email FROM active", "active"),
        "room_messages": statement("""
          SELECT 'newest' AS read, room, message_id, user_id, created_at, message_type, message, CAST(n AS INTEGER) AS age_rank FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY message_id DESC) AS n FROM open_rooms) WHERE n <= 50
          UNION ALL SELECT * FROM (SELECT 'after_id', room, message_id, user_id, created_at, message_type, message, NULL FROM open_rooms WHERE room = 'global' AND message_id > 60000 ORDER BY message_id LIMIT 200)
          UNION ALL SELECT * FROM (SELECT 'after_time', room, message_id, user_id, created_at, message_type, message, NULL FROM open_rooms WHERE room = 'room1' AND created_at > epoch(TIMESTAMP '2025-01-04 00:05:00') ORDER BY message_id LIMIT 40)
          UNION ALL SELECT * FROM (SELECT 'tail', room, message_id, user_id, created_at, message_type, message, NULL FROM open_rooms WHERE room = 'room2' ORDER BY message_id DESC LIMIT 30)""", "open_rooms"),
        "room_summary": statement("""
          SELECT room, max(message_id) AS latest_message_id, arg_max(user_id, message_id) AS latest_user_id, arg_max(created_at, message_id) AS latest_created_at, count(*) FILTER (message_id > 100000) AS unread_count,
            count(*) FILTER (message_id > 100000) > 0 AS has_newer FROM open_rooms GROUP BY room""", "open_rooms"),
        "dm_threads": statement("SELECT * FROM threads", "threads"),
        "dm_conversation": statement("""
          SELECT message_id, sender_id, recipient_id, created_at, text FROM private_messages WHERE (sender_id = 1 AND recipient_id = 8) OR (sender_id = 8 AND recipient_id = 1) ORDER BY created_at DESC, message_id DESC LIMIT 100""", "private_messages"),
        "inbox_summary": statement("SELECT user_id, count(*) AS thread_count, CAST(sum(unread_count) AS BIGINT) AS total_unread FROM threads GROUP BY 1", "threads"),
        "media_messages": statement("""
          SELECT message_id, user_id, image_path, total > 20 AS has_more FROM (SELECT *, row_number() OVER (ORDER BY message_id DESC) AS n, count(*) OVER () AS total FROM open_rooms
            WHERE room = 'global' AND message_type = 'image' AND image_path IS NOT NULL AND message_id < 90000) WHERE n <= 20""", "open_rooms"),
        "chat_retention": statement("SELECT * FROM expired_rows", "expired_rows"),
        "expired_media": statement("SELECT DISTINCT path FROM (SELECT unnest([audio_path, image_path]) AS path FROM expired_rows) WHERE path IS NOT NULL", "expired_rows"),
        "user_search": statement(f"""
          SELECT user_id, {NAME} AS display_name, email FROM active WHERE user_id <> 2 AND (contains(lower(coalesce(display_name, '')), 'er 1') OR contains(lower(email), 'er 1'))
          ORDER BY lower(coalesce(display_name, email)), user_id LIMIT 25 OFFSET 3""", "active"),
        "police_reports": statement(f"""
          SELECT report_id, user_id, zone_id, created_at, {rounded(['lat', 'lng'])}, (SELECT count(*) FROM reports WHERE lower(type) = 'police' AND created_at >= {NOW} - 86400) AS reports_24h
          FROM reports r WHERE lower(type) = 'police' ORDER BY created_at DESC, report_id DESC LIMIT 500""", "reports"),
        "admin_summary": statement(f"""
          SELECT (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM users WHERE is_admin) AS admin_users, (SELECT count(*) FROM presence WHERE seen_at >= {NOW} - 300) AS online_users,
            (SELECT count(*) FROM presence JOIN users USING (user_id) WHERE seen_at >= {NOW} - 300 AND ghost_mode) AS ghosted_online_users, (SELECT count(*) FROM reports WHERE lower(type) = 'police' AND created_at >= {NOW} - 86400) AS police_reports_24h,
            (SELECT count(*) FROM pickups WHERE created_at >= {NOW} - 86400 AND NOT is_voided) AS pickups_24h, (SELECT count(*) FROM pickups WHERE created_at >= {NOW} - 86400 AND is_voided) AS voided_pickups_24h""", "users", "presence", "reports", "pickups"),
        "table_counts": statement(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in ("users", "pickups", "reports", "room_messages", "private_messages", "daily_stats", "battles")),
                                  "users", "pickups", "reports", "room_messages", "private_messages", "daily_stats", "battles"),
        "user_detail": statement(f"""
          SELECT u.user_id, email, display_name, is_admin, is_disabled, is_suspended, ghost_mode, created_at, seen_at AS last_seen_at, (SELECT count(*) FROM pickups p WHERE p.user_id = u.user_id AND NOT is_voided) AS pickup_count,
            (SELECT count(*) FROM pickups p WHERE p.user_id = u.user_id AND is_voided) AS voided_pickup_count, (SELECT count(*) FROM reports r WHERE r.user_id = u.user_id AND lower(type) = 'police') AS police_report_count, {rounded(['lat', 'lng'])}
          FROM users u LEFT JOIN presence q ON q.user_id = u.user_id""", "users", "presence", "pickups", "reports"),
        "account_purge": statement(" UNION ALL ".join(
            f"SELECT '{t}' AS table_name, 'deleted' AS what, count(*) FILTER ({w}) AS rows, count(*) FILTER (NOT ({w})) AS remaining FROM {t}" for t, w in _PURGE.items())
            + f" UNION ALL SELECT 'outcomes', 'anonymized', count(*) FILTER (user_id {_IN}), count(*) FROM resolved_outcomes",
            "purge_users", "resolved_outcomes", *_PURGE),
        "purged_media": statement(f"""
          SELECT DISTINCT path FROM (SELECT audio_path AS path FROM room_messages WHERE user_id {_IN}
            UNION ALL SELECT audio_path FROM private_messages WHERE sender_id {_IN} OR recipient_id {_IN}) WHERE path IS NOT NULL""", "purge_users", "room_messages", "private_messages"),
        "subscription_state": statement(f"""
          SELECT f.user_id, applied_events, coalesce(f.status, d.subscription_status, CASE WHEN created THEN 'trialing' END) AS subscription_status, coalesce(sub, d.subscription_id, sub_fill) AS subscription_id,
            coalesce(cus, d.customer_id, cus_fill) AS customer_id, coalesce(f.period_end, d.subscription_current_period_end) AS current_period_end, coalesce(updated_at, d.subscription_updated_at) AS updated_at
          FROM (SELECT user_id, count(*) AS applied_events, {_last(_STATUS)} AS status, bool_or(event_type = 'subscription.created') AS created, {_last('period_end')} AS period_end, max(occurred_at) FILTER (NOT idle) AS updated_at,
              {_last(f'CASE WHEN {sub} THEN subscription_id END')} AS sub, {_last(f'CASE WHEN NOT {sub} THEN subscription_id END', 'arg_min')} AS sub_fill,
              {_last(f'CASE WHEN {sub} THEN customer_id END')} AS cus, {_last(f'CASE WHEN NOT {sub} THEN customer_id END', 'arg_min')} AS cus_fill FROM sub_applied_{ROUNDS - 1} GROUP BY 1) f JOIN drivers d ON d.user_id = f.user_id""", f"sub_applied_{ROUNDS - 1}", "drivers"),
        "access_status": statement(f"""
          SELECT user_id, {paid} AS paid, {comp} AS comp, {trial} AS trial, is_admin AS admin, CASE WHEN {paid} THEN {days.format('subscription_current_period_end')} END AS paid_days,
            CASE WHEN {comp} AND comp_expires_at IS NOT NULL THEN {days.format('comp_expires_at')} END AS comp_days, CASE WHEN {trial} THEN {days.format('trial_expires_at')} END AS trial_days,
            {kind} AS access, {kind} <> 'none' AS has_access FROM users""", "users"),
        "active_comps": statement(f"""
          SELECT user_id, email, display_name, comp_reason, comp_expires_at, {days.format('comp_expires_at')} AS days_remaining, comp_expires_at IS NULL AS is_forever FROM users
          WHERE {comp} AND (contains(email, 'r') OR contains(lower(display_name), 'r') OR contains(comp_reason, 'r'))""", "users"),
        "campaign_audience": statement("SELECT user_id, email, display_name, comp_reason FROM users WHERE comp_reason LIKE 'grandfathered:%' AND user_id % 8 <> 0", "users"),
    }
