"""DuckDB statements for the driver, leaderboard, battle and game operators."""

from __future__ import annotations

from oracle.base import NOW, rounded, statement, view

TODAY = "DATE '2025-06-18'"


def local(epoch: str) -> str:
    return (f"((CAST(make_timestamp(CAST({epoch} AS BIGINT) * 1000000) AS TIMESTAMP) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')")


def business(epoch: str) -> str:
    return f"CAST({local(epoch)} - INTERVAL 4 HOUR AS DATE)"


def boundary(day: str) -> str:
    """UTC epoch of 04:00 New York time on a date."""
    return f"CAST(epoch((CAST({day} AS TIMESTAMP) + INTERVAL 4 HOUR) AT TIME ZONE 'America/New_York') AS BIGINT)"


def haversine(a: str, b: str, c: str, d: str) -> str:
    h = (f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))")
    return f"2 * 6371000.0 * CAST(0.000621371 AS DOUBLE) * asin(sqrt(CASE WHEN {h} > 1 THEN 1 ELSE {h} END))"


view("segments", f"""
  SELECT event_id, user_id, seen_at, gap_seconds, miles, mph,
    CASE WHEN mph BETWEEN 1 AND 100 AND miles >= 0.01 THEN least(gap_seconds, 300) ELSE 0 END AS counted_seconds,
    CASE WHEN mph BETWEEN 1 AND 100 AND miles >= 0.01 THEN miles ELSE 0 END AS counted_miles
  FROM (SELECT *, CASE WHEN gap_seconds > 0 THEN miles / (gap_seconds / CAST(3600 AS DOUBLE)) END AS mph
        FROM (SELECT *, seen_at - pat AS gap_seconds, {haversine('plat', 'plng', 'lat', 'lng')} AS miles
              FROM (SELECT *, lag(seen_at) OVER w AS pat, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM heartbeats
                    WINDOW w AS (PARTITION BY user_id ORDER BY seen_at, event_id))))""", "heartbeats")
view("split", f"""
  SELECT event_id, user_id, d AS nyc_date, seconds, counted_miles * seconds / counted_seconds AS split_miles FROM (
    SELECT s.*, d, least(seen_at, {boundary('d + 1')}) - greatest(seen_at - counted_seconds, {boundary('d')}) AS seconds
    FROM (SELECT *, unnest([{business('seen_at - counted_seconds')}, {business('seen_at - counted_seconds')} + 1]) AS d FROM segments WHERE counted_seconds > 0) s)
  WHERE seconds > 0""", "segments")
view("driver_days", f"""
  SELECT user_id, nyc_date, sum(miles) AS miles_worked, sum(seconds) / CAST(3600 AS DOUBLE) AS hours_worked, CAST(sum(beats) AS BIGINT) AS heartbeat_count,
    CAST(sum(trips) AS BIGINT) AS trips_recorded, CAST(sum(pick) AS BIGINT) AS pickups_recorded
  FROM (SELECT user_id, nyc_date, split_miles AS miles, seconds, 0 AS beats, 0 AS trips, 0 AS pick FROM split
        UNION ALL SELECT user_id, {business('seen_at')}, 0, 0, 1, 0, 0 FROM heartbeats
        UNION ALL SELECT user_id, {business('created_at')}, 0, 0, 0, 1, CAST(counted_for_stats AS INTEGER) FROM pickups WHERE NOT is_voided)
  GROUP BY ALL""", "split", "heartbeats", "pickups")
NAME = "substr(CASE WHEN trim(coalesce(display_name, '')) <> '' THEN trim(display_name) ELSE split_part(email, '@', 1) END, 1, 28)"
ACTIVE = "NOT coalesce(is_disabled, FALSE) AND NOT coalesce(is_suspended, FALSE)"
BADGE = "CASE {0} WHEN 1 THEN 'crown' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END"
STEP = "CASE WHEN level = 1 THEN 0 ELSE round_even(round(120 + (level - 1) * 26 + pow(level - 1, CAST(1.28 AS DOUBLE)) * 7, 7), 0) END"
view("levels", f"""
  SELECT CAST(level AS INTEGER) AS level, CAST(sum({STEP}) OVER (ORDER BY level) AS BIGINT) AS xp, CAST((level - 1) // 10 + 1 AS INTEGER) AS band
  FROM range(1, 1001) r(level)""")
view("awards", """
  SELECT match_id, u AS user_id, min(coalesce(xp, 0)) AS xp_awarded FROM (SELECT match_id, unnest([winner_id, loser_id]) AS u, unnest([winner_xp_awarded, loser_xp_awarded]) AS xp FROM matches WHERE status IN ('completed', 'forfeited'))
  WHERE u IS NOT NULL GROUP BY ALL""", "matches")


def _progress(name: str, games: str) -> None:
    view(name, f"""
      SELECT s.*, (SELECT count(*) FROM levels WHERE xp <= total_xp) AS level FROM (
        SELECT user_id, CAST(sum(m) AS BIGINT) AS lifetime_miles, CAST(sum(h) AS BIGINT) AS lifetime_hours, CAST(sum(p) AS BIGINT) AS lifetime_pickups,
          CAST(sum(m * 8) AS BIGINT) AS miles_xp, CAST(sum(h * 30) AS BIGINT) AS hours_xp, CAST(sum(least(p, 25) * 20) AS BIGINT) AS report_xp,
          CAST(sum(g) AS BIGINT) AS game_xp, CAST(sum(m * 8 + h * 30 + least(p, 25) * 20 + g) AS BIGINT) AS total_xp
        FROM (SELECT user_id, miles_worked AS m, hours_worked AS h, pickups_recorded AS p, 0 AS g FROM daily_stats {games}) GROUP BY user_id) s""",
         "levels", "daily_stats", *(["awards"] if games else []))


_progress("progress", "UNION ALL SELECT user_id, 0, 0, 0, xp_awarded FROM awards")
_progress("progress_work", "")


def _board(metric: str, where: str, key: str, limit: str = "") -> str:
    return f"""
      SELECT user_id, display_name, metric_value, rank_position, {key} AS period_key, {BADGE.format('rank_position')} AS badge_code FROM (
        SELECT user_id, {NAME} AS display_name, CAST(sum({metric}) AS BIGINT) AS metric_value,
          row_number() OVER (ORDER BY sum({metric}) DESC, user_id) AS rank_position
        FROM daily_stats JOIN drivers USING (user_id) WHERE {where} AND {ACTIVE} GROUP BY user_id, {NAME}) {limit}"""


view("sides", """SELECT battle_id, metric, start_date, end_date, unnest(['a', 'b']) AS side, unnest([challenger_id, challenged_id]) AS user_id FROM battles""", "battles")


def _totals(name: str, where: str, end: str) -> None:
    def total(side, start):
        uid = "challenger_id" if side == "a" else "challenged_id"
        return (f"greatest(coalesce((SELECT CAST(sum(CASE WHEN b.metric = 'miles' THEN miles_worked ELSE hours_worked END) AS BIGINT) FROM daily_stats s "
                f"WHERE s.user_id = b.{uid} AND s.nyc_date BETWEEN b.start_date AND {end}), 0) - {start}, 0)")
    view(name, f"SELECT b.*, {total('a', 'challenger_start')} AS challenger_value, {total('b', 'challenged_start')} AS challenged_value FROM battles b WHERE {where}", "battles", "daily_stats")


_totals("due", f"status = 'active' AND ends_at <= {NOW}", "b.end_date")
_totals("live", "status = 'active'", f"least(b.end_date, {TODAY})")
_RESULT = "CASE WHEN challenger_value > challenged_value THEN 'challenger_win' WHEN challenged_value > challenger_value THEN 'challenged_win' ELSE 'tie' END"
_WIN = "CASE WHEN challenger_value > challenged_value THEN challenger_id WHEN challenged_value > challenger_value THEN challenged_id END"
_LOSE = "CASE WHEN challenger_value > challenged_value THEN challenged_id WHEN challenged_value > challenger_value THEN challenger_id END"
_WEEK = "date_trunc('week', nyc_date)::DATE"
_PERIODS = {
    "daily": ("nyc_date", "nyc_date", "CAST(nyc_date AS VARCHAR)"),
    "weekly": (_WEEK, f"{_WEEK} + 6", f"CAST({_WEEK} AS VARCHAR) || '_' || CAST({_WEEK} + 6 AS VARCHAR)"),
    "monthly": ("date_trunc('month', nyc_date)::DATE", "last_day(nyc_date)", "strftime(nyc_date, '%Y-%m')"),
    "yearly": ("date_trunc('year', nyc_date)::DATE", "(date_trunc('year', nyc_date) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE", "strftime(nyc_date, '%Y')"),
}
_OVER = {"daily": f"nyc_date = {TODAY}", "weekly": "nyc_date BETWEEN DATE '2025-06-16' AND DATE '2025-06-22'",
         "monthly": "nyc_date BETWEEN DATE '2025-06-01' AND DATE '2025-06-30'", "yearly": "year(nyc_date) = 2025"}
_COUNTER = "CASE WHEN side = 1 THEN {0} ELSE {1} END"


def statements() -> dict[str, str]:
    bands = "'Band ' || lpad(CAST(band AS VARCHAR), 3, '0') AS rank_name, 'band_' || lpad(CAST(band AS VARCHAR), 3, '0') AS rank_icon_key"
    return {
        "business_date": statement(f"SELECT CAST({business('seen_at')} AS VARCHAR) AS nyc_date, count(*) AS heartbeats, min(seen_at) AS first_at, max(seen_at) AS last_at FROM heartbeats GROUP BY 1", "heartbeats"),
        "heartbeat_segments": statement(f"SELECT event_id, user_id, gap_seconds, {rounded(['miles', 'mph', 'counted_miles'])}, counted_seconds FROM segments", "segments"),
        "split_by_business_day": statement(f"SELECT event_id, user_id, CAST(nyc_date AS VARCHAR) AS nyc_date, seconds, {rounded(['split_miles'])} FROM split", "split"),
        "driver_daily_stats": statement(f"SELECT user_id, CAST(nyc_date AS VARCHAR) AS nyc_date, {rounded(['miles_worked', 'hours_worked'])}, heartbeat_count, trips_recorded, pickups_recorded FROM driver_days", "driver_days"),
        "period_bounds": statement("SELECT CAST(nyc_date AS VARCHAR) AS nyc_date, count(*) AS driver_days, " + ", ".join(
            f"CAST({s} AS VARCHAR) AS {p}_start, CAST({e} AS VARCHAR) AS {p}_end, {k} AS {p}_key" for p, (s, e, k) in _PERIODS.items()) + " FROM daily_stats GROUP BY daily_stats.nyc_date", "daily_stats"),
        "leaderboard": statement(_board("miles_worked", _OVER["yearly"], "'2025'"), "daily_stats", "drivers"),
        "leaderboard_top": statement(_board("hours_worked", _OVER["monthly"], "'2025-06'", "WHERE rank_position <= 100"), "daily_stats", "drivers"),
        "my_rank": statement(_board("miles_worked", _OVER["yearly"], "'2025'", "WHERE user_id = 42"), "daily_stats", "drivers"),
        "current_badges": statement(f"SELECT user_id, rank_position, period_key, badge_code FROM ({_board('miles_worked', _OVER['daily'], chr(39) + '2025-06-18' + chr(39), 'WHERE rank_position <= 3')})", "daily_stats", "drivers"),
        "user_overview": statement("SELECT user_id, " + ", ".join(
            f"CAST(sum(CASE WHEN {w} THEN {c} ELSE 0 END) AS BIGINT) AS {p}_{c.split('_')[0]}" for p, w in {**_OVER, "lifetime": "TRUE"}.items() for c in ("miles_worked", "hours_worked", "pickups_recorded")) + " FROM daily_stats GROUP BY user_id", "daily_stats"),
        "progression": statement(f"""
          SELECT p.*, {bands.replace('band AS', 'l.band AS')}, l.xp AS current_level_xp, n.xp AS next_level_xp, coalesce(greatest(n.xp - total_xp, 0), 0) AS xp_to_next_level, p.level = 1000 AS max_level_reached
          FROM progress p JOIN levels l ON l.level = p.level LEFT JOIN levels n ON n.level = p.level + 1""", "progress", "levels"),
        "level_thresholds": statement(f"SELECT l.level, xp, band, {bands}, (SELECT count(*) FROM progress_work p WHERE p.level = l.level) AS drivers FROM levels l", "levels", "progress_work"),
        "period_report": statement(f"""
          SELECT user_id, email, display_name, coalesce(miles, 0) AS miles, coalesce(hours, 0) AS hours, coalesce(pickups, 0) AS pickups, miles_rank, hours_rank, '2025-05' AS period_key, {BADGE.format('least(miles_rank, hours_rank)')} AS badge_code
          FROM (SELECT user_id, CASE WHEN user_id % 29 = 0 THEN ' ' WHEN user_id % 31 <> 0 THEN email END AS email, {NAME} AS display_name FROM drivers WHERE {ACTIVE}) u LEFT JOIN (
            SELECT *, row_number() OVER (ORDER BY miles DESC, user_id) AS miles_rank, row_number() OVER (ORDER BY hours DESC, user_id) AS hours_rank FROM (
              SELECT user_id, CAST(sum(miles_worked) AS BIGINT) AS miles, CAST(sum(hours_worked) AS BIGINT) AS hours, CAST(sum(pickups_recorded) AS BIGINT) AS pickups
              FROM daily_stats JOIN drivers USING (user_id) WHERE nyc_date BETWEEN DATE '2025-05-01' AND DATE '2025-05-31' AND {ACTIVE} GROUP BY user_id)) r USING (user_id)
          WHERE user_id % 4 <> 0 AND user_id % 7 <> 0 AND user_id % 3 <> 1 AND trim(email) <> ''""", "daily_stats", "drivers"),
        "battle_settlement": statement(f"SELECT battle_id, challenger_value, challenged_value, {_WIN} AS winner_id, {_LOSE} AS loser_id, {_RESULT} AS result_code, 'completed' AS status, CAST({NOW} AS BIGINT) AS completed_at FROM due", "due"),
        "battle_standings": statement(f"SELECT battle_id, challenger_value, challenged_value, {_WIN} AS leader_id FROM live", "live"),
        "battle_history": statement(f"""
          SELECT battle_id, period || '_' || metric AS battle_type, {_RESULT} AS result_code, {_COUNTER.format('challenger_id', 'challenged_id')} AS user_id, {_COUNTER.format('challenged_id', 'challenger_id')} AS opponent_id,
            {_COUNTER.format('challenger_value', 'challenged_value')} AS my_value, {_COUNTER.format('challenged_value', 'challenger_value')} AS other_value
          FROM (SELECT *, unnest([1, 2]) AS side FROM due)""", "due"),
        "battle_conflicts": statement("""
          SELECT battle_id, EXISTS (SELECT 1 FROM battles b WHERE b.status IN ('pending', 'active') AND b.metric = r.metric AND b.period = r.period
              AND least(b.challenger_id, b.challenged_id) = least(r.challenger_id, r.challenged_id) AND greatest(b.challenger_id, b.challenged_id) = greatest(r.challenger_id, r.challenged_id)) AS duplicate,
            (metric, period, challenger_id) IN (SELECT (metric, period, u) FROM busy) OR (metric, period, challenged_id) IN (SELECT (metric, period, u) FROM busy) AS overlap
          FROM battles r WHERE status = 'declined'""".replace("FROM busy", "FROM (SELECT metric, period, unnest([challenger_id, challenged_id]) AS u FROM battles WHERE status = 'active')"), "battles"),
        "expire_pending": statement(f"SELECT CASE WHEN status = 'pending' AND expires_at <= {NOW} THEN 'expired' ELSE status END AS status, metric, count(*) AS battles, min(expires_at) AS first_expiry FROM battles GROUP BY 1, 2", "battles"),
        "game_record": statement("""
          SELECT user_id, count(*) FILTER (winner_id = user_id) AS wins, count(*) FILTER (winner_id <> user_id) AS losses, count(*) AS matches_played,
            string_agg(CAST(match_id AS VARCHAR), ',' ORDER BY match_id DESC) FILTER (n <= 10) AS recent_matches
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY match_id DESC) AS n FROM (SELECT *, unnest([player_one_id, player_two_id]) AS user_id FROM matches)) GROUP BY user_id""", "matches"),
        "game_xp": statement("SELECT * FROM awards", "awards"),
        "user_cards": statement(f"""
          SELECT u.user_id, {NAME} AS display_name, coalesce(seen_at >= {NOW} - 300 AND NOT ghost_mode AND {ACTIVE}, FALSE) AS online, CAST(p.level AS INTEGER) AS level,
            'band_' || lpad(CAST((p.level - 1) // 10 + 1 AS VARCHAR), 3, '0') AS rank_icon_key, b.badge_code
          FROM users u LEFT JOIN (SELECT user_id, max(seen_at) AS seen_at FROM heartbeats GROUP BY 1) h USING (user_id) LEFT JOIN progress_work p USING (user_id)
          LEFT JOIN (SELECT user_id, {BADGE.format('n')} AS badge_code FROM (SELECT user_id, row_number() OVER (ORDER BY miles_worked DESC, user_id) AS n
            FROM daily_stats JOIN users USING (user_id) WHERE nyc_date = {TODAY} AND {ACTIVE}) WHERE n <= 3) b USING (user_id)""", "users", "heartbeats", "progress_work", "daily_stats"),
        "relationship_status": statement("""
          SELECT viewer_id, target_id, relationship, battle_id FROM (
            SELECT *, row_number() OVER (PARTITION BY viewer_id, target_id ORDER BY status = 'active' DESC, battle_id DESC) AS n FROM (
              SELECT battle_id, status, challenger_id AS viewer_id, challenged_id AS target_id, CASE WHEN status = 'active' THEN 'active_match' ELSE 'outgoing_challenge' END AS relationship FROM battles WHERE status IN ('active', 'pending')
              UNION ALL SELECT battle_id, status, challenged_id, challenger_id, CASE WHEN status = 'active' THEN 'active_match' ELSE 'incoming_challenge' END FROM battles WHERE status IN ('active', 'pending'))) WHERE n = 1""", "battles"),
    }
