"""DuckDB statements for the tendency operators."""

from __future__ import annotations

from oracle.base import even, rounded, statement, view
from oracle import zone_bins  # noqa: F401  (registers the scored view)

view("t_local", """
  SELECT PULocationID AS zone_id, driver_pay, CAST(make_timestamp(pickup_epoch * 1000000) AS DATE) AS nyc_date,
    CAST(isodow(make_timestamp(pickup_epoch * 1000000)) - 1 AS INTEGER) AS weekday, CAST(pickup_epoch % 86400 // 1200 AS INTEGER) AS bin_index
  FROM trips""", "trips")
view("t_daily", "SELECT nyc_date, count(*) AS daily_pickups FROM t_local GROUP BY 1", "t_local")
view("t_usable", """
  SELECT nyc_date, daily_pickups FROM (
    SELECT *, median(daily_pickups) OVER () AS med FROM t_daily
    WHERE (SELECT count(*) FROM t_daily) < 3 OR (nyc_date > (SELECT min(nyc_date) FROM t_daily) AND nyc_date < (SELECT max(nyc_date) FROM t_daily)))
  WHERE daily_pickups >= greatest(200, 0.20 * med)""", "t_daily")
view("t_borough", "SELECT zone_id, replace(lower(borough_name), ' ', '_') AS borough_key, borough_name AS borough FROM zones", "zones")
view("t_bins", """
  SELECT nyc_date, weekday, bin_index, coalesce(borough_key, 'unknown') AS borough_key, coalesce(borough, 'Unknown') AS borough,
    count(*) AS pickups_bin, avg(driver_pay) AS avg_pay_bin, count(DISTINCT l.zone_id) AS active_zones_bin
  FROM t_local l LEFT JOIN t_borough b ON b.zone_id = l.zone_id GROUP BY ALL""", "t_local", "t_borough")
view("t_bridge", """
  SELECT * FROM (VALUES ('root','manhattan'),('root','brooklyn'),('root','queens'),('root','bronx'),('root','staten_island'),
    ('citywide','manhattan'),('citywide','brooklyn'),('citywide','queens'),('citywide','bronx'),('citywide','staten_island'),
    ('manhattan_mode','manhattan'),('staten_island_mode','staten_island'),('bronx_wash_heights_mode','bronx'),('bronx_wash_heights_mode','manhattan'),
    ('queens_mode','queens'),('brooklyn_mode','brooklyn'),('manhattan','manhattan'),('staten_island','staten_island'),('queens','queens'),
    ('brooklyn','brooklyn'),('bronx','bronx'),('bronx_wash_heights','bronx'),('bronx_wash_heights','manhattan')) v(scope, borough_key)""")
view("t_scoped", "SELECT scope, b.* FROM t_bins b JOIN t_bridge USING (borough_key) WHERE nyc_date IN (SELECT nyc_date FROM t_usable)", "t_bins", "t_bridge", "t_usable")
_MEANS = (f"count(*) AS sample_bins, {even('avg(pickups_bin)', 2)} AS pickups_avg, {even('avg(coalesce(avg_pay_bin, 0))', 2)} AS pay_avg, "
          f"{even('avg(active_zones_bin)', 2)} AS zones_avg")
view("t_cohorts", " UNION ALL ".join(
    f"SELECT scope, '{kind}' AS cohort_type, {b} AS borough_key, {d} AS weekday, {i} AS bin_index, {_MEANS} FROM t_scoped GROUP BY scope{by}"
    for kind, b, d, i, by in (
        ("borough_weekday_bin", "borough_key", "weekday", "bin_index", ", borough_key, weekday, bin_index"),
        ("borough_bin", "borough_key", "NULL::INTEGER", "bin_index", ", borough_key, bin_index"),
        ("borough_baseline", "borough_key", "NULL::INTEGER", "NULL::INTEGER", ", borough_key"),
        ("global_bin", "NULL::VARCHAR", "NULL::INTEGER", "bin_index", ", bin_index"))), "t_scoped")


def _mid(col: str) -> str:
    return (f"(SELECT CASE WHEN count(*) <= 1 THEN CAST(0.5 AS DOUBLE) ELSE (count(*) FILTER (o.{col} < c.{col}) + count(*) FILTER (o.{col} <= c.{col}) - 1) / 2 / CAST(count(*) - 1 AS DOUBLE) END "
            f"FROM t_cohorts o WHERE o.scope = c.scope AND o.cohort_type = c.cohort_type)")


view("t_strength", f"SELECT c.*, {_mid('pickups_avg')} AS pickup_strength, {_mid('pay_avg')} AS pay_strength, {_mid('zones_avg')} AS breadth_strength FROM t_cohorts c", "t_cohorts")
# Score mix per scope: pickups, pay, breadth, min(pickups, breadth).
_MIX = """(VALUES ('manhattan_mode', 0.57, 0.09, 0.22, 0.12), ('staten_island_mode', 0.58, 0.24, 0.18, 0.0), ('bronx_wash_heights_mode', 0.72, 0.12, 0.16, 0.0),
  ('queens_mode', 0.67, 0.11, 0.22, 0.0), ('brooklyn_mode', 0.80, 0.10, 0.10, 0.0)) mix(mix_scope, w_pickups, w_pay, w_breadth, w_both)"""
_RAW = """CAST(coalesce(w_pickups, 0.70) AS DOUBLE) * pickup_strength + CAST(coalesce(w_pay, 0.15) AS DOUBLE) * pay_strength
  + CAST(coalesce(w_breadth, 0.15) AS DOUBLE) * breadth_strength + CAST(coalesce(w_both, 0.0) AS DOUBLE) * least(pickup_strength, breadth_strength)"""
_LABEL = ("(CASE WHEN (bin_index * 20 // 60) % 12 = 0 THEN 12 ELSE (bin_index * 20 // 60) % 12 END) || ':' || lpad(CAST(bin_index * 20 % 60 AS VARCHAR), 2, '0') "
          "|| CASE WHEN bin_index * 20 // 60 < 12 THEN ' AM' ELSE ' PM' END")


def _score_view(name: str, source: str) -> None:
    view(name, f"""
      SELECT *, CASE WHEN score <= 34 THEN 'low' WHEN score <= 64 THEN 'normal' ELSE 'high' END AS band,
        CASE WHEN score <= 34 THEN 'Low' WHEN score <= 64 THEN 'Normal' ELSE 'High' END AS label,
        {even('least(1, sample_bins / CAST(12 AS DOUBLE))', 2)} AS confidence,
        'Typical ' || CASE cohort_type WHEN 'borough_weekday_bin' THEN borough || ' ' || ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][weekday + 1] || 's around ' || {_LABEL}
          WHEN 'borough_bin' THEN borough || ' time blocks around ' || {_LABEL} WHEN 'borough_baseline' THEN borough || ' time blocks'
          WHEN 'global_bin' THEN 'time blocks around ' || {_LABEL} ELSE 'time blocks in this dataset' END || ' are ' ||
          CASE WHEN raw4 >= 0.65 THEN 'stronger than most time blocks in this dataset' WHEN raw4 <= 0.34 THEN 'weaker than most time blocks in this dataset' ELSE 'near the middle of this dataset' END || '.' AS sentence
      FROM (SELECT *, CAST(least(greatest({even('100 * score_raw')}, 0), 100) AS INTEGER) AS score, {even('score_raw', 4)} AS raw4,
              CASE borough_key WHEN 'staten_island' THEN 'Staten Island' ELSE upper(borough_key[1]) || borough_key[2:] END AS borough
            FROM (SELECT s.*, {_RAW} AS score_raw FROM {source} s LEFT JOIN {_MIX} ON mix_scope = scope))""", source)


_score_view("t_scored", "t_strength")
view("t_means", """SELECT scope, count(*) AS sample_bins, round(avg(pickups_bin), 9) AS mp, round(avg(coalesce(avg_pay_bin, 0)), 9) AS my, round(avg(active_zones_bin), 9) AS mz
  FROM t_scoped GROUP BY scope""", "t_scoped")


def _place(col: str, mean: str) -> str:
    return (f"CASE WHEN count(*) <= 1 THEN CAST(0.5 AS DOUBLE) ELSE least(greatest((count(*) FILTER ({col} < {mean}) + count(*) FILTER ({col} <= {mean}) - 1) / 2 / CAST(count(*) - 1 AS DOUBLE), 0), 1) END")


view("t_placed", f"""
  SELECT scope, 'global_baseline' AS cohort_type, NULL::VARCHAR AS borough_key, NULL::INTEGER AS weekday, NULL::INTEGER AS bin_index, m.sample_bins,
    {even('mp', 2)} AS pickups_avg, {even('my', 2)} AS pay_avg, {even('mz', 2)} AS zones_avg,
    {_place('c.pickups_avg', 'mp')} AS pickup_strength, {_place('c.pay_avg', 'my')} AS pay_strength, {_place('c.zones_avg', 'mz')} AS breadth_strength
  FROM t_cohorts c JOIN t_means m USING (scope) WHERE cohort_type = 'global_bin' GROUP BY scope, m.sample_bins, mp, my, mz""", "t_cohorts", "t_means")
_score_view("t_base", "t_placed")
COHORT = "scope, cohort_type, borough_key, weekday, bin_index"
STRENGTHS = rounded(["pickup_strength", "pay_strength", "breadth_strength"])
SCORE = "score, band, label, confidence, sentence"
_CORE = "borough_name LIKE '%Manhattan%' AND zone_id NOT IN (41, 42, 74, 75, 116, 127, 128, 151, 152, 166, 243, 244) AND centroid_latitude < CAST(40.795 AS DOUBLE)"
_NORTH = "(borough_name LIKE '%Bronx%' OR zone_id IN (41, 42, 74, 75, 116, 127, 128, 151, 152, 166, 243, 244))"
_FAMILIES = [("citywide_all", "citywide", "TRUE"), ("auto_manhattan_citywide", "citywide", _CORE), ("auto_bronx_wash_heights_citywide", "citywide", _NORTH),
             ("auto_queens_citywide", "citywide", "borough_name = 'Queens'"), ("auto_brooklyn_citywide", "citywide", "borough_name = 'Brooklyn'"),
             ("mode_manhattan", "manhattan", _CORE), ("mode_bronx_wash_heights", "bronx_wash_heights", _NORTH), ("mode_queens", "queens", "borough_name = 'Queens'"),
             ("mode_brooklyn", "brooklyn", "borough_name = 'Brooklyn'"), ("mode_staten_island", "staten_island", "borough_name = 'Staten Island'")]


def _context() -> str:
    steps = [("r.scope", k) for k in ("borough_weekday_bin", "borough_bin", "borough_baseline")] + [("'root'", k) for k in ("borough_weekday_bin", "borough_bin", "borough_baseline")]
    joins, n = [], 0
    for scope, kind in steps:
        n += 1
        cond = f"m{n}.scope = {scope} AND m{n}.cohort_type = '{kind}' AND m{n}.borough_key = r.borough_key"
        if kind != "borough_baseline":
            cond += f" AND m{n}.bin_index = r.bin_index"
        if kind == "borough_weekday_bin":
            cond += f" AND m{n}.weekday = r.weekday"
        joins.append(f"LEFT JOIN t_scored m{n} ON {cond}")
    pick = lambda c: f"coalesce({', '.join(f'm{i}.{c}' for i in range(1, 7))})"
    layer = "CASE " + " ".join(
        f"WHEN m{i}.score IS NOT NULL THEN '{'scope' if i <= 3 else 'root'}'" for i in range(1, 7)) + " END"
    spec = "CASE " + " ".join(
        f"WHEN m{i}.score IS NOT NULL THEN " + (f"'{steps[i - 1][1]}'" if i <= 3 else f"'root_{steps[i - 1][1]}_fallback'") for i in range(1, 7)) + " END"
    return f"""
      SELECT r.scope, r.borough_key, r.weekday, r.bin_index, {pick('score')} AS score, {pick('confidence')} AS confidence, {pick('sample_bins')} AS sample_bins,
        {layer} AS source_layer, {spec} AS source_specificity, coalesce({layer}, '') = 'root' AS broad_scope_fallback
      FROM (SELECT DISTINCT s.scope, borough_key, weekday, bin_index FROM t_local l JOIN t_borough USING (zone_id), (SELECT DISTINCT scope FROM t_bridge) s) r {' '.join(joins)}"""


def statements() -> dict[str, str]:
    return {
        "daily_pickups": statement("SELECT CAST(nyc_date AS VARCHAR) AS nyc_date, daily_pickups FROM t_daily", "t_daily"),
        "usable_dates": statement("SELECT CAST(nyc_date AS VARCHAR) AS nyc_date, daily_pickups FROM t_usable", "t_usable"),
        "borough_bins": statement(f"SELECT CAST(nyc_date AS VARCHAR) AS nyc_date, weekday, bin_index, borough_key, borough, pickups_bin, {rounded(['avg_pay_bin'])}, active_zones_bin FROM t_bins", "t_bins"),
        "borough_canonical": statement("SELECT * FROM t_borough", "t_borough"),
        "tendency_cohorts": statement("SELECT * FROM t_cohorts WHERE scope = 'root'", "t_cohorts"),
        "midrank_percentile": statement(f"SELECT {COHORT}, {STRENGTHS} FROM t_strength WHERE scope = 'root'", "t_strength"),
        "tendency_score": statement(f"SELECT {COHORT}, {rounded(['score_raw'])}, {SCORE} FROM t_scored WHERE scope = 'root'", "t_scored"),
        "tendency_scopes": statement(f"SELECT {COHORT}, sample_bins, {rounded(['score_raw'])}, {SCORE} FROM t_scored", "t_scored"),
        "tendency_global_baseline": statement(f"SELECT scope, sample_bins, pickups_avg, pay_avg, zones_avg, {STRENGTHS}, {SCORE} FROM t_base", "t_base"),
        "tendency_context": statement(_context(), "t_scored", "t_local", "t_borough", "t_bridge"),
        "month_family_benchmark": statement(" UNION ALL ".join(
            f"SELECT '{k}' AS family, {even(f'avg(coalesce(rating_{p}_v3, rating_{p}_v2))', 2)} AS average_rating, count(*) AS sample_zone_frames FROM scored WHERE {c} HAVING count(*) > 0" for k, p, c in _FAMILIES), "scored"),
        "bin_label": statement(f"SELECT bin_index, count(*) AS trips, {_LABEL} AS bin_label FROM t_local GROUP BY bin_index", "t_local"),
    }
