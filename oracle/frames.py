"""DuckDB statements for the frame operators."""

from __future__ import annotations

from oracle.base import even, r6, rounded, statement, view
from oracle.zone_bins import FAMILIES, V3_NAMES, bucket, color

CORRIDOR = "zone_id IN (41, 42, 74, 75, 116, 127, 128, 151, 152, 166, 243, 244)"
ELIGIBLE = {
    "citywide_v3": "TRUE", "manhattan_v3": f"(borough_name = 'Manhattan' AND NOT {CORRIDOR} AND centroid_latitude <= CAST(40.795 AS DOUBLE))",
    "bronx_wash_heights_v3": f"(borough_name = 'Bronx' OR {CORRIDOR})", "queens_v3": "borough_name = 'Queens'",
    "brooklyn_v3": "borough_name = 'Brooklyn'", "staten_island_v3": "borough_name = 'Staten Island'",
}
MIX = {"manhattan_v3": (0.18, 0.18, 0.50, 0.14), "bronx_wash_heights_v3": (0.22, 0.20, 0.46, 0.12), "queens_v3": (0.22, 0.20, 0.46, 0.12),
       "brooklyn_v3": (0.22, 0.20, 0.46, 0.12), "staten_island_v3": (0.10, 0.30, 0.44, 0.16)}


def _visible(source: str) -> str:
    return (f"SELECT *, {bucket('visible_rating')} AS visible_bucket, {color('visible_rating')} AS visible_color FROM ("
            f"SELECT *, CAST({even('1 + 99 * visible_score')} AS INTEGER) AS visible_rating FROM ("
            f"SELECT *, least(greatest(0.62 * visible_base + 0.38 * sqrt(visible_base), 0), 1) AS visible_score FROM ({source})))")


def _rank(part: str, order: str) -> str:
    return (f"CASE WHEN count(*) OVER (PARTITION BY {part}) <= 1 THEN 0 ELSE (row_number() OVER (PARTITION BY {part} ORDER BY {order}) - 1) "
            f"/ CAST(count(*) OVER (PARTITION BY {part}) - 1 AS DOUBLE) END")


view("vis_city", _visible(f"""
  SELECT *, least(greatest(0.40 * visible_rank + 0.46 * s + 0.14 * c, 0), 1) AS visible_base FROM (
    SELECT *, {_rank('bin_local_epoch', 's, c, zone_id')} AS visible_rank FROM (
      SELECT *, round(score_citywide_v3_candidate, 9) AS s, round(confidence_citywide_v3_candidate, 9) AS c FROM scored))"""), "scored")
view("vis_rows", " UNION ALL ".join(
    f"SELECT bin_local_epoch, zone_id, '{p}' AS profile, visible_base AS anchor, round(score_{p}, 9) AS s, round(confidence_{p}, 9) AS c, "
    f"{m[0]} AS m0, {m[1]} AS m1, {m[2]} AS m2, {m[3]} AS m3 FROM vis_city WHERE {ELIGIBLE[p]}" for p, m in MIX.items()), "vis_city")
view("vis_profiles", _visible(f"""
  SELECT bin_local_epoch, zone_id, profile, visible_rank, least(greatest(m0 * anchor + m1 * visible_rank + m2 * s + m3 * c, 0), 1) AS visible_base FROM (
    SELECT *, {_rank('bin_local_epoch, profile', 's, c, zone_id')} AS visible_rank FROM vis_rows)"""), "vis_rows")
_S = "(bin_local_epoch // 1200 + zone_id)"
view("popup", f"""
  SELECT *, coalesce(dn, pickups_now / zone_area_sq_miles) AS pickups_per_sq_mile_now, coalesce(dx, pickups_next / zone_area_sq_miles) AS pickups_per_sq_mile_next FROM (
    SELECT *, greatest(coalesce(a, CASE WHEN dn > 0 THEN greatest(pickups_now / dn, 0.01) WHEN dx > 0 THEN greatest(pickups_next / dx, 0.01) ELSE 1 END), 0.01) AS zone_area_sq_miles FROM (
      SELECT *, coalesce(kn, pickups_now / a) AS dn, coalesce(kx, pickups_next / a) AS dx FROM (
        SELECT bin_local_epoch, zone_id, CAST(CASE WHEN {_S} % 7 <> 0 THEN pickups_now ELSE {_S} % 13 END AS DOUBLE) AS pickups_now,
          CAST(CASE WHEN {_S} % 5 <> 0 THEN pickups_next WHEN {_S} % 7 <> 0 THEN pickups_now ELSE {_S} % 13 END AS DOUBLE) AS pickups_next,
          CASE WHEN {_S} % 3 <> 0 THEN zone_area_sq_miles WHEN {_S} % 9 <> 0 THEN zone_area_sq_miles END AS a,
          CASE WHEN {_S} % 4 <> 0 THEN pickups_per_sq_mile_now END AS kn, CASE WHEN {_S} % 6 NOT IN (0, 1) THEN pickups_per_sq_mile_next END AS kx
        FROM joined)))""", "joined")
view("candidate_rows", " UNION ALL ".join(
    f"SELECT bin_local_epoch, zone_id, zone_name, '{p}' AS profile, round(delta_{p}, 9) AS delta, bucket_{p} AS lb, bucket_{p}_candidate AS cb, rating_{p} AS live_rating, rating_{p}_candidate AS candidate_rating FROM scored WHERE {ELIGIBLE[p]}"
    for p in V3_NAMES), "scored")
_ORDER = "list_position(['red','orange','yellow','sky','blue','indigo','purple','green'], {0})"
view("candidate_top", f"""
  SELECT *, CASE WHEN {_ORDER.format('cb')} > {_ORDER.format('lb')} THEN 'better' WHEN {_ORDER.format('cb')} < {_ORDER.format('lb')} THEN 'worse' ELSE 'same' END AS direction FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY bin_local_epoch, profile ORDER BY delta, zone_id) AS INTEGER) AS demotion_rank,
      CAST(row_number() OVER (PARTITION BY bin_local_epoch, profile ORDER BY delta DESC, zone_id) AS INTEGER) AS promotion_rank FROM candidate_rows)
  WHERE demotion_rank <= 20 OR promotion_rank <= 20""", "candidate_rows")
FACTS = ("pickups_now", "pickups_next", "pickups_per_sq_mile_now", "pickups_per_sq_mile_next", "median_driver_pay", "short_trip_share", "same_zone_share", "downstream_value_raw")
view("deciles", "SELECT profile, CAST(least(greatest(ceil(rating / 10.0), 1), 10) AS INTEGER) AS decile, count(*) AS row_count, "
     + ", ".join(f"avg({x}) AS avg_{x}" for x in FACTS) + " FROM (" + " UNION ALL ".join(
         f"SELECT '{p}' AS profile, rating_{p} AS rating, {', '.join(FACTS)} FROM scored" for p in FAMILIES) + ") GROUP BY 1, 2", "scored")
VIS = f"{rounded(['visible_rank', 'visible_base', 'visible_score'])}, visible_rating, visible_bucket, visible_color"
POPUP = ("pickups_now", "pickups_next", "zone_area_sq_miles", "pickups_per_sq_mile_now", "pickups_per_sq_mile_next")


def _mismatch() -> str:
    parts = []
    for p in FAMILIES:
        b = f"CASE WHEN {_S} % 50 = 0 THEN 'red' ELSE bucket_{p} END" if p == "citywide_v3" else f"bucket_{p}"
        c = f"CASE WHEN {_S} % 60 <> 0 THEN color_{p} END" if p == "queens_v2" else f"color_{p}"
        parts.append(f"SELECT bin_local_epoch, zone_id, '{p}' AS family, rating_{p} AS rating, {b} AS bucket, {c} AS color FROM scored")
    return f"""SELECT *, {bucket('rating')} AS expected_bucket, {color('rating')} AS expected_color FROM ({' UNION ALL '.join(parts)})
      WHERE bucket IS DISTINCT FROM {bucket('rating')} OR color IS DISTINCT FROM {color('rating')}"""


def statements() -> dict[str, str]:
    d = "count(*) FILTER (delta > 0.03) AS promoted, count(*) FILTER (delta < -0.03) AS demoted"
    a, x = "abs(pickups_now - zone_area_sq_miles * pickups_per_sq_mile_now) > 2", "abs(pickups_next - zone_area_sq_miles * pickups_per_sq_mile_next) > 2"
    return {
        "profile_eligibility": statement("SELECT zone_id, " + ", ".join(f"NOT airport_excluded AND {e} AS eligible_{p}" for p, e in ELIGIBLE.items()) + " FROM zones", "zones"),
        "visible_citywide": statement(f"SELECT bin_local_epoch, zone_id, 'citywide_v3_trap_candidate' AS citywide_source, {VIS} FROM vis_city", "vis_city"),
        "visible_profiles": statement(f"SELECT bin_local_epoch, zone_id, profile, {VIS} FROM vis_profiles", "vis_profiles"),
        "airport_exclusion": statement("""
          SELECT bin_local_epoch, zone_id, zone_name, CAST(0 AS DOUBLE) AS visible_rank, CAST(0 AS DOUBLE) AS visible_base, CAST(0 AS DOUBLE) AS visible_score, 1 AS visible_rating, 'red' AS visible_bucket, '#e60000' AS visible_color
          FROM zones, (SELECT DISTINCT bin_local_epoch FROM binned) WHERE airport_excluded""", "zones", "binned"),
        "citywide_source_switch": statement(f"""
          SELECT bin_local_epoch, zone_id, CASE WHEN gone THEN 'citywide_v3_fallback_from_missing_candidate' ELSE 'citywide_v3_trap_candidate' END AS citywide_source,
            {r6('CASE WHEN gone THEN score_citywide_v3 ELSE score_citywide_v3_candidate END')} AS source_score, {r6('CASE WHEN gone THEN confidence_citywide_v3 ELSE confidence_citywide_v3_candidate END')} AS source_confidence
          FROM (SELECT *, bin_local_epoch // 1200 % 3 = 0 AS gone FROM scored)""", "scored"),
        "popup_metrics": statement(f"SELECT bin_local_epoch, zone_id, {rounded(POPUP)} FROM popup", "popup"),
        "popup_consistency_check": statement(f"""
          SELECT bin_local_epoch, zone_id, 'pickups_now mismatch' AS reason FROM popup WHERE {a} UNION ALL SELECT bin_local_epoch, zone_id, 'pickups_next mismatch' FROM popup WHERE {x}""", "popup"),
        "rating_bucket_check": statement(_mismatch(), "scored"),
        "candidate_review_frame": statement(f"""
          SELECT bin_local_epoch, profile, count(*) AS eligible_zones, count(*) FILTER (abs(delta) > 0.000001) AS changed, {d}, count(*) FILTER (delta BETWEEN -0.03 AND 0.03) AS near_unchanged,
            {r6('avg(delta)')} AS average_delta, {r6('median(delta)')} AS median_delta, {r6('min(delta)')} AS min_delta, {r6('max(delta)')} AS max_delta FROM candidate_rows GROUP BY 1, 2""", "candidate_rows"),
        "candidate_review_top": statement(f"SELECT bin_local_epoch, zone_id, profile, live_rating, candidate_rating, direction, demotion_rank, promotion_rank, {r6('delta')} AS delta FROM candidate_top", "candidate_top"),
        "candidate_review_totals": statement(f"""
          SELECT profile, count(DISTINCT bin_local_epoch) AS frames, count(*) AS zone_observations, {d}, {r6('avg(delta)')} AS average_delta, {r6('min(delta)')} AS min_delta, {r6('max(delta)')} AS max_delta
          FROM candidate_rows GROUP BY 1""", "candidate_rows"),
        "candidate_review_month": statement(f"""
          SELECT profile, side, zone_id, zone_name, appearances, position, {rounded(['average_delta', 'cumulative_delta', 'worst_delta', 'best_delta'])} FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY profile, side ORDER BY sgn * average_delta, sgn * round(cumulative_delta, 9), zone_id) AS INTEGER) AS position FROM (
              SELECT profile, side, sgn, zone_id, zone_name, count(*) AS appearances, sum(delta) AS cumulative_delta, min(delta) AS worst_delta, max(delta) AS best_delta, round(sum(delta) / count(*), 9) AS average_delta
              FROM (SELECT *, 'demotion' AS side, 1 AS sgn FROM candidate_top WHERE demotion_rank <= 20 AND delta < -0.03 UNION ALL SELECT *, 'promotion', -1 FROM candidate_top WHERE promotion_rank <= 20 AND delta > 0.03)
              GROUP BY ALL)) WHERE position <= 30""", "candidate_top"),
        "frame_field_completeness": statement("""
          SELECT bin_local_epoch, count(*) AS features, TRUE AS has_citywide, TRUE AS has_borough, bool_and(zone_area_sq_miles IS NOT NULL AND pickups_per_sq_mile_now IS NOT NULL) AS has_density, bool_and(same_zone_n IS NOT NULL) AS has_trap, bool_and(pickups_next IS NOT NULL) AS has_popup
          FROM scored WHERE bin_local_epoch IN (SELECT bin_local_epoch FROM (SELECT bin_local_epoch, row_number() OVER (ORDER BY bin_local_epoch) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT bin_local_epoch FROM scored)) WHERE i IN (0, n // 2, n - 1))
          GROUP BY 1""", "scored"),
        "score_decile_report": statement(f"SELECT profile, decile, row_count, {rounded([f'avg_{f}' for f in FACTS])} FROM deciles", "deciles"),
        "score_decile_trend": statement(f"""
          SELECT profile, fact, comparisons, matching, {r6('matching / CAST(comparisons AS DOUBLE)')} AS ratio, matching / CAST(comparisons AS DOUBLE) >= 0.70 AS generally FROM (
            SELECT a.profile, fact, count(*) AS comparisons, count(*) FILTER (round(b.v - a.v, 9) * sgn >= 0) AS matching FROM
              (SELECT profile, decile, unnest(['pickups_next', 'pickups_per_sq_mile_next', 'short_trip_share', 'same_zone_share']) AS fact, unnest([1, 1, -1, -1]) AS sgn,
                unnest([avg_pickups_next, avg_pickups_per_sq_mile_next, avg_short_trip_share, avg_same_zone_share]) AS v FROM deciles) a
              JOIN (SELECT profile, decile, unnest(['pickups_next', 'pickups_per_sq_mile_next', 'short_trip_share', 'same_zone_share']) AS fact,
                unnest([avg_pickups_next, avg_pickups_per_sq_mile_next, avg_short_trip_share, avg_same_zone_share]) AS v FROM deciles) b USING (profile, fact)
            WHERE b.decile = a.decile + 1 GROUP BY 1, 2)""", "deciles"),
    }
