"""DuckDB statements for the trip, zone-bin, rank and score operators."""

from __future__ import annotations

from oracle.base import r6, rounded, statement, view

LOCAL = ("CAST(epoch((CAST(make_timestamp({0} * 1000000) AS TIMESTAMP) AT TIME ZONE 'UTC') "
         "AT TIME ZONE 'America/New_York') AS BIGINT)")

view("prepared", f"""
  SELECT PULocationID AS zone_id, DOLocationID AS drop_zone_id, pickup_epoch, request_epoch, driver_pay, trip_time, trip_miles,
    airport_fee, shared_match_flag AS shared_flag, {LOCAL.format('pickup_epoch')} AS local_epoch,
    (pickup_epoch - request_epoch) / CAST(60 AS DOUBLE) AS request_min,
    driver_pay / greatest(trip_time / 60.0, CAST(1 AS DOUBLE) / 60.0) AS pay_per_min,
    driver_pay / greatest(trip_miles, CAST(0.1 AS DOUBLE)) AS pay_per_mile
  FROM trips WHERE PULocationID IN (SELECT zone_id FROM zones WHERE NOT airport_excluded)""", "trips", "zones")
view("binned", """
  SELECT *, local_epoch // 1200 * 1200 AS bin_local_epoch,
    CASE WHEN trip_miles <= 3.0 AND trip_time <= 720.0 THEN 1 ELSE 0 END AS is_short,
    CASE WHEN shared_flag = 1 THEN 1 ELSE 0 END AS is_shared,
    CASE WHEN trip_time >= 1200 THEN 1 ELSE 0 END AS is_long,
    CASE WHEN trip_miles BETWEEN 3.0 AND 10.0 AND trip_time BETWEEN 720.0 AND 2400.0 THEN 1 ELSE 0 END AS is_balanced,
    CASE WHEN drop_zone_id = zone_id THEN 1 ELSE 0 END AS is_same_zone,
    CASE WHEN coalesce(airport_fee, 0) > 0 OR drop_zone_id IN (SELECT zone_id FROM zones WHERE airport_excluded) THEN 1 ELSE 0 END AS is_airport_exit,
    ext AS is_out_of_network, 1 - ext AS is_network_drop,
    CASE WHEN ext = 1 AND trip_miles <= 6.0 AND trip_time <= 1800.0 THEN 1 ELSE 0 END AS is_short_external_6mi,
    CASE WHEN ext = 1 AND trip_miles <= 8.0 AND trip_time <= 2400.0 THEN 1 ELSE 0 END AS is_short_external_8mi,
    CASE WHEN ext = 1 AND trip_miles >= 12.0 AND coalesce(driver_pay, 0) >= 25.0 THEN 1 ELSE 0 END AS is_long_external
  FROM (SELECT *, CASE WHEN drop_zone_id IS NULL OR drop_zone_id NOT IN (SELECT zone_id FROM zones WHERE NOT airport_excluded) THEN 1 ELSE 0 END AS ext
        FROM prepared)""", "prepared")

SHARES = {
    "short_trip_share": "is_short", "shared_ride_share": "is_shared", "long_trip_share": "is_long",
    "balanced_trip_share": "is_balanced", "same_zone_share": "is_same_zone", "airport_exit_share": "is_airport_exit",
    "out_of_network_share": "is_out_of_network", "short_external_share_6mi": "is_short_external_6mi",
    "short_external_share_8mi": "is_short_external_8mi", "long_external_share": "is_long_external",
}
MEDIANS = ("median_driver_pay", "median_pay_per_min", "median_pay_per_mile", "median_request_min")

view("zone_bin_actual", f"""
  SELECT zone_id, bin_local_epoch, count(*) AS pickups_now,
    round(median(driver_pay), 9) AS median_driver_pay, round(median(pay_per_min), 9) AS median_pay_per_min,
    round(median(pay_per_mile), 9) AS median_pay_per_mile,
    round(median(CASE WHEN request_min >= 0 THEN request_min END), 9) AS median_request_min,
    {', '.join(f'avg({c}) AS {n}' for n, c in SHARES.items())}
  FROM binned GROUP BY ALL""", "binned")
view("grid", """
  SELECT zone_id, zone_name, borough_name, zone_area_sq_miles, centroid_latitude, bin_local_epoch
  FROM zones CROSS JOIN (SELECT DISTINCT bin_local_epoch FROM binned) WHERE NOT airport_excluded""", "zones", "binned")
view("with_next", """
  SELECT *, coalesce(lead(pickups_now) OVER (PARTITION BY zone_id, bin_local_epoch // 21600 ORDER BY bin_local_epoch), pickups_now) AS pickups_next
  FROM zone_bin_actual""", "zone_bin_actual")
view("zone_bin", f"""
  SELECT g.zone_id, g.bin_local_epoch, zone_name, borough_name, zone_area_sq_miles, centroid_latitude,
    coalesce(pickups_now, 0) AS pickups_now, coalesce(pickups_next, 0) AS pickups_next, {', '.join(MEDIANS)},
    {', '.join(f'coalesce({s}, 0) AS {s}' for s in SHARES)}
  FROM grid g LEFT JOIN with_next w ON w.zone_id = g.zone_id AND w.bin_local_epoch = g.bin_local_epoch""", "grid", "with_next")
view("edges", """
  SELECT zone_id, drop_zone_id, bin_local_epoch, edge_trips,
    CAST(sum(edge_trips) OVER (PARTITION BY zone_id, bin_local_epoch) AS BIGINT) AS edge_total,
    lead(bin_local_epoch) OVER (PARTITION BY zone_id, bin_local_epoch // 21600 ORDER BY bin_local_epoch, drop_zone_id) AS lookup_bin
  FROM (SELECT zone_id, drop_zone_id, bin_local_epoch, count(*) AS edge_trips FROM binned WHERE is_network_drop = 1 GROUP BY ALL)""", "binned")
view("downstream", """
  SELECT e.zone_id, e.bin_local_epoch,
    round(sum(edge_trips / edge_total * CASE WHEN z.zone_id IS NULL THEN 0
      ELSE (0.50 * ln(1 + pickups_now) + coalesce(0.35 * median_driver_pay, 0) + coalesce(0.15 * median_pay_per_min, 0))
         / (CAST(0.50 AS DOUBLE) + CASE WHEN median_driver_pay IS NULL THEN 0 ELSE 0.35 END + CASE WHEN median_pay_per_min IS NULL THEN 0 ELSE 0.15 END) END), 9) AS downstream_value_raw,
    sum(CASE WHEN z.zone_id IS NULL THEN 0 ELSE edge_trips END) / CAST(sum(edge_trips) AS DOUBLE) AS downstream_coverage
  FROM edges e LEFT JOIN zone_bin z ON z.zone_id = e.drop_zone_id AND z.bin_local_epoch = e.lookup_bin
  GROUP BY ALL""", "edges", "zone_bin")
view("joined", """
  SELECT z.*, coalesce(downstream_value_raw, 0) AS downstream_value_raw, coalesce(downstream_coverage, 0) AS downstream_coverage,
    CASE WHEN zone_area_sq_miles > 0 THEN round(pickups_now / zone_area_sq_miles, 9) END AS pickups_per_sq_mile_now,
    CASE WHEN zone_area_sq_miles > 0 THEN round(pickups_next / zone_area_sq_miles, 9) END AS pickups_per_sq_mile_next
  FROM zone_bin z LEFT JOIN downstream d ON d.zone_id = z.zone_id AND d.bin_local_epoch = z.bin_local_epoch""", "zone_bin", "downstream")


def _rank(col: str, n: str = "*") -> str:
    return (f"CASE WHEN count({n}) OVER (PARTITION BY bin_local_epoch) <= 1 THEN CAST(0 AS DOUBLE) ELSE "
            f"(row_number() OVER (PARTITION BY bin_local_epoch ORDER BY {col} ASC NULLS LAST, zone_id) - 1) / "
            f"CAST(count({n}) OVER (PARTITION BY bin_local_epoch) - 1 AS DOUBLE) END")


def _guard(col: str, pickups: str) -> str:
    return f"CASE WHEN {pickups} <= 0 OR {col} IS NULL THEN CAST(0 AS DOUBLE) ELSE {_rank(col, col)} END"


RANKS = {
    "demand_now_n": _guard("pickups_now", "pickups_now"), "demand_next_n": _guard("pickups_next", "pickups_next"),
    "density_now_n": _guard("pickups_per_sq_mile_now", "pickups_now"),
    "density_next_n": _guard("pickups_per_sq_mile_next", "pickups_next"),
    **{out: f"CASE WHEN {c} IS NOT NULL THEN {_rank(c, c)} END" for out, c in {
        "pay_n": "median_driver_pay", "pay_per_min_n": "median_pay_per_min", "pay_per_mile_n": "median_pay_per_mile",
        "long_trip_n": "long_trip_share", "balanced_trip_n": "balanced_trip_share", "same_zone_n": "same_zone_share",
        "airport_exit_n": "airport_exit_share", "out_of_network_n": "out_of_network_share",
        "short_external_6mi_n": "short_external_share_6mi", "short_external_8mi_n": "short_external_share_8mi",
        "long_external_n": "long_external_share"}.items()},
    **{out: _rank(c) for out, c in {
        "pickup_friction_n": "median_request_min", "short_trip_n": "short_trip_share",
        "shared_ride_n": "shared_ride_share", "downstream_n": "downstream_value_raw"}.items()},
}
view("ranked", f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in RANKS.items())} FROM joined", "joined")


def _c(expr: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"least(greatest(({expr}), CAST({low} AS DOUBLE)), CAST({high} AS DOUBLE))"


CORE = ("(lower(borough_name) LIKE '%manhattan%' AND centroid_latitude <= CAST(40.795 AS DOUBLE) "
        "AND zone_id NOT IN (41, 42, 74, 75, 116, 127, 128, 151, 152, 166, 243, 244))")

# Saturation multipliers; 0.35 elsewhere. The first that fits counts.
BOROUGHS = ("[{'word': 'manhattan', 'factor': 1.00}, {'word': 'brooklyn', 'factor': 0.55}, {'word': 'queens', 'factor': 0.50}, "
            "{'word': 'bronx', 'factor': 0.40}, {'word': 'staten', 'factor': 0.20}]")

view("features_1", f"""
  SELECT *, greatest(demand_now_n, demand_next_n) AS demand_support_n,
    {_c('0.20 + 0.80 * greatest(demand_now_n, demand_next_n)')} AS density_support_n,
    coalesce(list_filter({BOROUGHS}, lambda b: contains(lower(borough_name), b.word))[1].factor, 0.35)::DOUBLE AS borough_multiplier,
    {_c('0.45 * same_zone_n + 0.35 * short_trip_n + 0.20 * greatest(density_now_n - greatest(demand_next_n, downstream_n), 0)')} AS churn_pressure_n
  FROM ranked""", "ranked")
view("features_2", f"""
  SELECT *, density_now_n * density_support_n AS effective_density_now_n, density_next_n * density_support_n AS effective_density_next_n,
    CASE WHEN {CORE} THEN churn_pressure_n ELSE 0 END AS core_saturation_n,
    {_c('0.24 * short_trip_n + 0.20 * same_zone_n + 0.18 * airport_exit_n + 0.18 * out_of_network_n + 0.14 * short_external_8mi_n - 0.10 * long_external_n - 0.10 * downstream_n')} AS return_risk
  FROM features_1""", "features_1")
view("features_3", f"""
  SELECT *, {_c('0.68 * demand_now_n + 0.32 * effective_density_now_n')} AS busy_now_n,
    {_c('0.62 * demand_next_n + 0.38 * effective_density_next_n')} AS busy_next_n,
    {_c('0.30 * effective_density_now_n + 0.15 * demand_support_n + 0.18 * short_trip_n + 0.16 * same_zone_n + 0.11 * (1 - coalesce(pay_per_mile_n, 0.5)) + 0.10 * (1 - downstream_n)')} AS market_pressure_n,
    {_c('0.42 * downstream_n + 0.18 * long_external_n + 0.16 * coalesce(pay_per_min_n, 0) + 0.12 * coalesce(pay_per_mile_n, 0) - 0.12 * return_risk')} AS escape_quality
  FROM features_2""", "features_2")
view("features", f"""
  SELECT *, {_c('market_pressure_n * borough_multiplier')} AS market_saturation_n,
    CASE WHEN {CORE} THEN {_c('1 - 0.14 * core_saturation_n', 0.86, 1.0)} ELSE 1 END AS core_discount,
    CASE WHEN {CORE} THEN {_c('0.52 * short_trip_n + 0.30 * same_zone_n + 0.18 * greatest(density_now_n - greatest(downstream_n, busy_next_n), 0)')} ELSE 0 END AS core_trap_n,
    CASE WHEN {CORE} THEN {_c('0.52 * balanced_trip_n + 0.28 * long_trip_n + 0.20 * downstream_n')} ELSE 0 END AS core_escape_n,
    coalesce(pay_n, 0.5) AS pay_s, coalesce(pay_per_min_n, 0.5) AS ppm_s, coalesce(pay_per_mile_n, 0.5) AS ppmi_s
  FROM features_3""", "features_3")

# Weights as a relation: profile and version, then the table's columns.
V2_TERMS = "demand_now_n demand_next_n pay_s ppm_s ppmi_s downstream_n".split()
V2_PENALTIES = "short_trip_n pickup_friction_n shared_ride_n".split()
V3_PENALTIES = "short_trip_n same_zone_n pickup_friction_n shared_ride_n market_saturation_n".split()


# Profile weights, in the order of the terms and penalties above; v3 has demand now,
# demand next, density now, density next, the pay terms, balanced share, long share, downstream.
V2_WEIGHTS = {
    "citywide_v2": (0.20, 0.14, 0.22, 0.16, 0.10, 0.12, 0.04, 0.03, 0.01),
    "manhattan_v2": (0.14, 0.18, 0.12, 0.20, 0.06, 0.18, 0.16, 0.10, 0.04),
    "bronx_wash_heights_v2": (0.18, 0.22, 0.08, 0.14, 0.05, 0.22, 0.05, 0.06, 0.03),
    "queens_v2": (0.15, 0.20, 0.08, 0.12, 0.11, 0.22, 0.06, 0.04, 0.02),
    "brooklyn_v2": (0.13, 0.18, 0.09, 0.19, 0.10, 0.20, 0.15, 0.07, 0.03),
    "staten_island_v2": (0.11, 0.17, 0.18, 0.14, 0.10, 0.19, 0.04, 0.05, 0.02),
}
V3_WEIGHTS = {
    "citywide_v3": (0.11, 0.11, 0.12, 0.09, 0.07, 0.12, 0.07, 0.10, 0.06, 0.11, 0.0855, 0.09, 0.045, 0.027, 0.03),
    "manhattan_v3": (0.08, 0.10, 0.11, 0.09, 0.07, 0.14, 0.08, 0.11, 0.02, 0.08, 0.055, 0.09, 0.032, 0.012, 0.0),
    "bronx_wash_heights_v3": (0.13, 0.15, 0.08, 0.07, 0.05, 0.09, 0.05, 0.08, 0.03, 0.14, 0.04275, 0.054, 0.036, 0.018, 0.0),
    "queens_v3": (0.10, 0.12, 0.12, 0.10, 0.05, 0.09, 0.10, 0.09, 0.06, 0.12, 0.0513, 0.081, 0.027, 0.018, 0.0),
    "brooklyn_v3": (0.09, 0.10, 0.12, 0.09, 0.06, 0.13, 0.08, 0.10, 0.06, 0.11, 0.0855, 0.099, 0.036, 0.018, 0.0),
    "staten_island_v3": (0.10, 0.12, 0.04, 0.04, 0.13, 0.13, 0.12, 0.11, 0.02, 0.07, 0.018, 0.020, 0.015, 0.005, 0.0),
}


def _dot(weights, terms) -> str:
    return "(" + " + ".join(f"CAST({w} AS DOUBLE) * {t}" for w, t in zip(weights, terms)) + ")"


def _v2(w) -> str:
    return _c(f"{_dot(w[:6], V2_TERMS)} / {sum(w[:6])!r} - {_dot(w[6:], V2_PENALTIES)}")


def _v3(w, balanced=None, long=None, saturation=None, plus="0", minus="0") -> str:
    now, nxt = f"CAST({w[0]} + {w[2]} AS DOUBLE)", f"CAST({w[1]} + {w[3]} AS DOUBLE)"
    b, g, s = balanced or str(w[7]), long or str(w[8]), saturation or str(w[14])
    positive = (f"({now} * busy_now_n + {nxt} * busy_next_n + {w[4]} * pay_s + {w[5]} * ppm_s + {w[6]} * ppmi_s"
                f" + {b} * balanced_trip_n + {g} * long_trip_n + {w[9]} * downstream_n)"
                f" / CAST({now} + {nxt} + {w[4]} + {w[5]} + {w[6]} + {b} + {g} + {w[9]} AS DOUBLE)")
    negative = f"{_dot(w[10:14], V3_PENALTIES[:4])} + {s} * market_saturation_n"
    return _c(f"{positive} + {plus} - ({negative} + {minus})")


# Ratings from which the next tier counts.
TIER_FLOORS = (48, 60, 73, 87)


def _tier(values) -> str:
    """The value of the tier; values go from the top tier down to the bottom one."""
    passed = " + ".join(f"(citywide_pre_tier_rating >= {floor})::INTEGER" for floor in TIER_FLOORS)
    return f"list_extract([{', '.join(map(str, reversed(values)))}], 1 + {passed})::DOUBLE"


CITY_PLUS = "0.045 * core_escape_n"
CITY_MINUS = "(0.100 * core_saturation_n + 0.110 * core_trap_n)"
V2_NAMES = ("citywide_v2", "manhattan_v2", "bronx_wash_heights_v2", "queens_v2", "brooklyn_v2", "staten_island_v2")
V3_NAMES = ("citywide_v3", "manhattan_v3", "bronx_wash_heights_v3", "queens_v3", "brooklyn_v3", "staten_island_v3")
TRAP = {
    "citywide_v3": (0.16, 0.05, 0.05, 0.07, 0.03, 0.76, 1.12), "manhattan_v3": (0.13, 0.04, 0.04, 0.07, 0.03, 0.78, 1.10),
    "bronx_wash_heights_v3": (0.15, 0.0, 0.04, 0.06, 0.03, 0.76, 1.12), "queens_v3": (0.18, 0.05, 0.06, 0.06, 0.03, 0.72, 1.12),
    "brooklyn_v3": (0.15, 0.0, 0.04, 0.06, 0.03, 0.76, 1.12), "staten_island_v3": (0.11, 0.0, 0.03, 0.08, 0.05, 0.80, 1.15),
}


def _score_views() -> None:
    v2, v3 = V2_WEIGHTS, V3_WEIGHTS
    view("tiered", f"""
      SELECT *, {_tier((0.080, 0.082, 0.090, 0.095, 0.100))} AS citywide_balanced_weight,
        {_tier((0.080, 0.078, 0.070, 0.065, 0.060))} AS citywide_long_weight,
        {_tier((0.060, 0.055, 0.045, 0.040, 0.030))} AS citywide_saturation_weight
      FROM (SELECT *, CAST(round(1 + 99 * round(citywide_pre_tier_raw, 9)) AS INTEGER) AS citywide_pre_tier_rating
            FROM (SELECT *, {_v3(v3['citywide_v3'], plus=CITY_PLUS, minus=CITY_MINUS)} AS citywide_pre_tier_raw FROM features))""", "features")
    raws = [f"{_v2(v2[p])} AS raw_{p}" for p in V2_NAMES]
    for p in V3_NAMES:
        if p == "citywide_v3":
            e = _v3(v3[p], "citywide_balanced_weight", "citywide_long_weight", "citywide_saturation_weight", CITY_PLUS, CITY_MINUS)
        elif p == "manhattan_v3":
            e = _v3(v3[p], minus="0.10 * core_saturation_n")
        else:
            e = _v3(v3[p])
        raws.append(f"{e} AS raw_{p}")
    view("raw_scores", f"""
      SELECT *, {', '.join(raws)}, {_c('pickups_now / CAST(5 AS DOUBLE)')} AS support_strength,
        least(1, pickups_now / CAST(40 AS DOUBLE)) * (0.70 + 0.30 * downstream_coverage) AS confidence_base FROM tiered""", "tiered")
    blend = {"manhattan_v3": ("0.75", "0.25 * balanced_trip_n"), "staten_island_v3": ("0.80", "0.20 * balanced_trip_n")}
    confs = [f"confidence_base * support_strength AS confidence_{p}" for p in V2_NAMES]
    for p in V3_NAMES:
        base, other = blend.get(p, ("0.85", "0.15 * demand_support_n"))
        confs.append(f"{_c(f'{base} * confidence_base + {other}')} * support_strength AS confidence_{p}")
    view("confident", f"SELECT *, {', '.join(confs)} FROM raw_scores", "raw_scores")
    scores = [_c(f"raw_{p} * confidence_{p}" + (" * core_discount" if p == "citywide_v3" else "")) + f" AS score_{p}"
              for p in (*V2_NAMES, *V3_NAMES)]
    view("scores", f"SELECT *, {', '.join(scores)} FROM confident", "confident")
    cand = []
    for p, (a, b, c, d, e, lo, hi) in TRAP.items():
        f = _c(f"1 - {a} * return_risk - {b} * airport_exit_n - {c} * short_external_8mi_n + {d} * escape_quality + {e} * long_external_n", lo, hi)
        cand.append(f"{_c(f'score_{p} * {f}')} AS score_{p}_candidate")
        cand.append(f"{_c(f'0.82 * confidence_{p} + 0.18 * (1 - return_risk + escape_quality) / 2')} * support_strength AS confidence_{p}_candidate")
    view("candidates", f"""
      SELECT *, {', '.join(f'score_{p}_candidate - score_{p} AS delta_{p}' for p in V3_NAMES)}
      FROM (SELECT *, {', '.join(cand)} FROM scores)""", "scores")
    fams = [*V2_NAMES, *V3_NAMES, *[f"{p}_candidate" for p in V3_NAMES]]
    view("rated", f"SELECT *, {', '.join(f'CAST(round(1 + 99 * round(score_{f}, 9)) AS INTEGER) AS rating_{f}' for f in fams)} FROM candidates", "candidates")
    view("scored", f"""SELECT *, {', '.join(f"{bucket(f'rating_{f}')} AS bucket_{f}, {color(f'rating_{f}')} AS color_{f}" for f in fams)} FROM rated""", "rated")


def bucket(r: str) -> str:
    return (f"CASE WHEN {r} >= 83 THEN 'green' WHEN {r} >= 75 THEN 'purple' WHEN {r} >= 68 THEN 'indigo' WHEN {r} >= 60 THEN 'blue' "
            f"WHEN {r} >= 50 THEN 'sky' WHEN {r} >= 40 THEN 'yellow' WHEN {r} >= 30 THEN 'orange' ELSE 'red' END")


def color(r: str) -> str:
    return (f"CASE WHEN {r} >= 83 THEN '#00b050' WHEN {r} >= 75 THEN '#8000ff' WHEN {r} >= 68 THEN '#4b3cff' WHEN {r} >= 60 THEN '#0066ff' "
            f"WHEN {r} >= 50 THEN '#66ccff' WHEN {r} >= 40 THEN '#ffd400' WHEN {r} >= 30 THEN '#ff8c00' ELSE '#e60000' END")


_score_views()

KEY = "zone_id, bin_local_epoch, "
FEATURES = {
    "busy_base": ["demand_support_n", "density_support_n", "effective_density_now_n", "effective_density_next_n", "busy_now_n", "busy_next_n"],
    "saturation_pressure": ["market_pressure_n", "borough_multiplier", "market_saturation_n"],
    "churn_pressure": ["churn_pressure_n"],
    "core_guard_features": ["core_saturation_n", "core_discount", "core_trap_n", "core_escape_n"],
    "return_risk_escape_quality": ["return_risk", "escape_quality"],
}
FAMILIES = [*V2_NAMES, *V3_NAMES, *[f"{p}_candidate" for p in V3_NAMES]]
WEEKDAY = "strftime(to_timestamp(bin_local_epoch) AT TIME ZONE 'UTC', '%a')"
FLAGS = ["is_short", "is_shared", "is_long", "is_balanced", "is_same_zone"]
EXITS = ["is_airport_exit", "is_network_drop", "is_out_of_network", "is_short_external_6mi", "is_short_external_8mi", "is_long_external"]


def _component_sql() -> str:
    v3 = V3_WEIGHTS
    out = []
    for p in V3_NAMES:
        w = v3[p]
        b, g, s = (("citywide_balanced_weight", "citywide_long_weight", "citywide_saturation_weight") if p == "citywide_v3" else (w[7], w[8], w[14]))
        mix = f"{b} * balanced_trip_n + {g} * long_trip_n" + (f" + {CITY_PLUS}" if p == "citywide_v3" else "")
        sat = f"{s} * market_saturation_n" + (f" + {CITY_MINUS}" if p == "citywide_v3" else " + 0.10 * core_saturation_n" if p == "manhattan_v3" else "")
        for n, e in {
            "busy": f"({w[0]} + {w[2]}) * busy_now_n + ({w[1]} + {w[3]}) * busy_next_n",
            "pay": f"{w[4]} * pay_s + {w[5]} * ppm_s + {w[6]} * ppmi_s", "mix": mix,
            "continuation": f"{w[9]} * downstream_n", "short_penalty": f"{w[10]} * short_trip_n",
            "retention_penalty": f"{w[11]} * same_zone_n",
            "friction_penalty": f"{w[12]} * pickup_friction_n + {w[13]} * shared_ride_n", "saturation_penalty": sat,
        }.items():
            out.append(f"{r6(e)} AS {n}_{p}")
    return f"SELECT {KEY}{', '.join(out)} FROM tiered"


def statements() -> dict[str, str]:
    out = {
        "trips_scan": statement("""
          SELECT zone_id, coalesce(drop_zone_id, -1) AS drop_zone_id, count(*) AS trips, CAST(sum(CAST(floor(driver_pay * 100 + 0.5) AS BIGINT)) AS BIGINT) AS pay_cents,
            CAST(sum(CAST(trip_time AS BIGINT)) AS BIGINT) AS seconds, min(pickup_epoch) AS first_pickup, max(pickup_epoch) AS last_pickup
          FROM (SELECT PULocationID AS zone_id, DOLocationID AS drop_zone_id, * FROM trips)
          WHERE pickup_epoch >= 1736208000 AND pickup_epoch < 1736467200 GROUP BY ALL""", "trips"),
        "trip_local_time": statement("SELECT zone_id, pickup_epoch, local_epoch, count(*) AS trips FROM prepared GROUP BY ALL", "prepared"),
        "trip_rates": statement(f"SELECT zone_id, pickup_epoch, request_epoch, trip_time, {rounded(['driver_pay', 'trip_miles', 'request_min', 'pay_per_min', 'pay_per_mile'])} FROM prepared", "prepared"),
        "trip_bin": statement(f"""
          SELECT bin_local_epoch, strftime(make_timestamp(bin_local_epoch * 1000000), '%Y-%m-%d') AS bin_date,
            strftime(make_timestamp(bin_local_epoch * 1000000), '%a') AS weekday_name,
            strftime(make_timestamp(bin_local_epoch * 1000000), '%H:%M') AS bin_time_label, count(*) AS trips
          FROM binned GROUP BY ALL""", "binned"),
        "trip_flags": statement(f"SELECT zone_id, bin_local_epoch, {', '.join(FLAGS)}, count(*) AS trips FROM binned GROUP BY ALL", "binned"),
        "trip_exit_flags": statement(f"SELECT zone_id, bin_local_epoch, {', '.join(EXITS)}, count(*) AS trips FROM binned GROUP BY ALL", "binned"),
        "airport_zone_flag": statement("SELECT zone_id, zone_name, borough_name, airport_excluded FROM zones", "zones"),
        "shared_flag_coalesce": statement("SELECT PULocationID AS zone_id, shared_match_flag AS shared_flag, count(*) AS trips FROM trips GROUP BY ALL", "trips"),
        "zone_bin_agg": statement(f"SELECT {KEY}pickups_now, {rounded([*MEDIANS, *SHARES])} FROM zone_bin_actual", "zone_bin_actual"),
        "zone_bin_grid": statement("SELECT zone_id, zone_name, borough_name, round(zone_area_sq_miles + 2.5e-9, 6) AS zone_area_sq_miles, bin_local_epoch FROM grid", "grid"),
        "zone_bin_filled": statement(f"SELECT {KEY}pickups_now, pickups_next, {rounded([*MEDIANS, *SHARES])} FROM zone_bin", "zone_bin"),
        "next_bin_pickups": statement(f"SELECT {KEY}pickups_now, pickups_next FROM with_next", "with_next"),
        "od_edges": statement(f"SELECT zone_id, drop_zone_id, bin_local_epoch, edge_trips, edge_total, {r6('edge_trips / CAST(edge_total AS DOUBLE)')} AS edge_share, lookup_bin FROM edges", "edges"),
        "downstream_value": statement(f"SELECT {KEY}{rounded(['downstream_value_raw', 'downstream_coverage'])} FROM downstream", "downstream"),
        "pickup_density": statement(f"SELECT {KEY}{rounded(['pickups_per_sq_mile_now', 'pickups_per_sq_mile_next'])} FROM joined", "joined"),
        "support_strength": statement(f"SELECT {KEY}{r6(_c('pickups_now / CAST(25 AS DOUBLE)'))} AS support_strength FROM zone_bin", "zone_bin"),
        "percentile_rank_in_bin": statement(f"SELECT {KEY}{rounded(['pickup_friction_n', 'short_trip_n', 'shared_ride_n', 'downstream_n'])} FROM ranked", "ranked"),
        "percentile_rank_nullable": statement(f"SELECT {KEY}{rounded(['pay_n', 'pay_per_min_n', 'pay_per_mile_n'])} FROM ranked", "ranked"),
        "percentile_rank_share": statement(f"SELECT {KEY}{rounded(['long_trip_n', 'balanced_trip_n', 'same_zone_n', 'airport_exit_n', 'out_of_network_n', 'short_external_6mi_n', 'short_external_8mi_n', 'long_external_n'])} FROM ranked", "ranked"),
        "demand_zero_guard": statement(f"SELECT {KEY}pickups_now, pickups_next, {rounded(['demand_now_n', 'demand_next_n', 'density_now_n', 'density_next_n'])} FROM ranked", "ranked"),
        "null_weighted_average": statement(f"""
          SELECT {KEY}{r6('''CASE WHEN median_driver_pay IS NULL THEN 0 ELSE (0.35 * median_driver_pay + 0.15 * coalesce(median_pay_per_min, 0) + 0.10 * coalesce(median_pay_per_mile, 0))
            / (CAST(0.35 AS DOUBLE) + CASE WHEN median_pay_per_min IS NULL THEN 0 ELSE 0.15 END + CASE WHEN median_pay_per_mile IS NULL THEN 0 ELSE 0.10 END) END''')} AS pay_quality FROM zone_bin""", "zone_bin"),
        **{k: statement(f"SELECT {KEY}{rounded(c)} FROM features", "features") for k, c in FEATURES.items()},
        "profile_score_v2": statement(f"SELECT {KEY}{rounded([f'raw_{p}' for p in V2_NAMES])} FROM raw_scores", "raw_scores"),
        "profile_score_v3": statement(f"SELECT {KEY}{rounded([f'raw_{p}' for p in V3_NAMES[1:]])} FROM raw_scores", "raw_scores"),
        "citywide_tiered_score": statement(f"SELECT {KEY}citywide_pre_tier_rating, {rounded(['citywide_pre_tier_raw', 'citywide_balanced_weight', 'citywide_long_weight', 'citywide_saturation_weight', 'raw_citywide_v3'])} FROM raw_scores", "raw_scores"),
        "profile_confidence": statement(f"SELECT {KEY}{rounded([f'confidence_{p}' for p in (*V2_NAMES, *V3_NAMES)] + [f'score_{p}' for p in (*V2_NAMES, *V3_NAMES)])} FROM scores", "scores"),
        "trap_candidate_score": statement(f"SELECT {KEY}{rounded([f'{k}_{p}' + s for p in V3_NAMES for k, s in (('score', '_candidate'), ('confidence', '_candidate'), ('delta', ''))])} FROM candidates", "candidates"),
        "rating_bucket_color": statement(f"SELECT {KEY}{', '.join(f'rating_{f}, bucket_{f}, color_{f}' for f in FAMILIES)} FROM scored", "scored"),
        "score_components": statement(_component_sql(), "tiered"),
        "zone_bin_scored": statement(f"""
          SELECT zone_id, zone_name, borough_name, bin_local_epoch, pickups_now, pickups_next,
            {rounded([*MEDIANS, *SHARES, 'downstream_value_raw', 'downstream_coverage', 'return_risk', 'escape_quality'])},
            {rounded([f'score_{f}' for f in FAMILIES])}, {rounded([f'confidence_{f}' for f in FAMILIES])}, {', '.join(f'rating_{f}' for f in FAMILIES)}
          FROM scored""", "scored"),
    }
    return out
