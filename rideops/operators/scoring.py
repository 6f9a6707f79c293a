"""Composite features and profile scores, driven by the weight tables below.

There are some three hundred expressions here, all scalar. They are written as Spark SQL
expression text: one call per column instead of one per operator keeps plan building short.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideops.functions.columns import RATING_BOTTOM, RATING_LADDER

MIN_TRIPS = 25

# Zones of the Bronx / Washington Heights corridor and the core latitude limit.
CORRIDOR_ZONE_IDS = (41, 42, 74, 75, 116, 127, 128, 151, 152, 166, 243, 244)
CORE_LATITUDE = 40.795

# Profile weights. v2: demand now, demand next, pay, pay per minute, pay per
# mile, downstream; penalties short trip, pickup friction, shared ride.
V2_WEIGHTS = {
    "citywide_v2": (0.20, 0.14, 0.22, 0.16, 0.10, 0.12, 0.04, 0.03, 0.01),
    "manhattan_v2": (0.14, 0.18, 0.12, 0.20, 0.06, 0.18, 0.16, 0.10, 0.04),
    "bronx_wash_heights_v2": (0.18, 0.22, 0.08, 0.14, 0.05, 0.22, 0.05, 0.06, 0.03),
    "queens_v2": (0.15, 0.20, 0.08, 0.12, 0.11, 0.22, 0.06, 0.04, 0.02),
    "brooklyn_v2": (0.13, 0.18, 0.09, 0.19, 0.10, 0.20, 0.15, 0.07, 0.03),
    "staten_island_v2": (0.11, 0.17, 0.18, 0.14, 0.10, 0.19, 0.04, 0.05, 0.02),
}
# v3: demand now, demand next, density now, density next, pay, pay per minute, pay per mile,
# balanced share, long share, downstream; penalties short trip, same zone, pickup friction,
# shared ride, market saturation.
V3_WEIGHTS = {
    "citywide_v3": (0.11, 0.11, 0.12, 0.09, 0.07, 0.12, 0.07, 0.10, 0.06, 0.11, 0.0855, 0.09, 0.045, 0.027, 0.03),
    "manhattan_v3": (0.08, 0.10, 0.11, 0.09, 0.07, 0.14, 0.08, 0.11, 0.02, 0.08, 0.055, 0.09, 0.032, 0.012, 0.0),
    "bronx_wash_heights_v3": (0.13, 0.15, 0.08, 0.07, 0.05, 0.09, 0.05, 0.08, 0.03, 0.14, 0.04275, 0.054, 0.036, 0.018, 0.0),
    "queens_v3": (0.10, 0.12, 0.12, 0.10, 0.05, 0.09, 0.10, 0.09, 0.06, 0.12, 0.0513, 0.081, 0.027, 0.018, 0.0),
    "brooklyn_v3": (0.09, 0.10, 0.12, 0.09, 0.06, 0.13, 0.08, 0.10, 0.06, 0.11, 0.0855, 0.099, 0.036, 0.018, 0.0),
    "staten_island_v3": (0.10, 0.12, 0.04, 0.04, 0.13, 0.13, 0.12, 0.11, 0.02, 0.07, 0.018, 0.020, 0.015, 0.005, 0.0),
}
V3_KEYS = ("demand_now", "demand_next", "density_now", "density_next", "pay", "pay_per_min", "pay_per_mile",
           "balanced", "long", "downstream", "short", "same_zone", "friction", "shared", "saturation")
# Pre-tier rating floors with balanced, long and saturation weights.
CITYWIDE_TIERS = (
    (87, 0.080, 0.080, 0.060),
    (73, 0.082, 0.078, 0.055),
    (60, 0.090, 0.070, 0.045),
    (48, 0.095, 0.065, 0.040),
)
CITYWIDE_TIER_BOTTOM = (0.100, 0.060, 0.030)
# Confidence blend (base weight, other weight, other column) per v3 profile.
CONFIDENCE_BLEND = {
    "citywide_v3": (0.85, 0.15, "demand_support_n"),
    "manhattan_v3": (0.75, 0.25, "balanced_trip_n"),
    "bronx_wash_heights_v3": (0.85, 0.15, "demand_support_n"),
    "queens_v3": (0.85, 0.15, "demand_support_n"),
    "brooklyn_v3": (0.85, 0.15, "demand_support_n"),
    "staten_island_v3": (0.80, 0.20, "balanced_trip_n"),
}
# Trap factors: return risk, airport exit, short external, escape quality, long
# external, lowest, highest.
TRAP_FACTORS = {
    "citywide_v3": (0.16, 0.05, 0.05, 0.07, 0.03, 0.76, 1.12),
    "manhattan_v3": (0.13, 0.04, 0.04, 0.07, 0.03, 0.78, 1.10),
    "bronx_wash_heights_v3": (0.15, 0.0, 0.04, 0.06, 0.03, 0.76, 1.12),
    "queens_v3": (0.18, 0.05, 0.06, 0.06, 0.03, 0.72, 1.12),
    "brooklyn_v3": (0.15, 0.0, 0.04, 0.06, 0.03, 0.76, 1.12),
    "staten_island_v3": (0.11, 0.0, 0.03, 0.08, 0.05, 0.80, 1.15),
}
# Saturation multiplier by borough.
BOROUGH_MULTIPLIERS = (
    ("manhattan", 1.00), ("brooklyn", 0.55), ("queens", 0.50), ("bronx", 0.40), ("staten", 0.20),
)
OTHER_BOROUGH_MULTIPLIER = 0.35


def _clip(text: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"least(greatest({text}, {low}D), {high}D)"


def _nvl(name: str, default: float = 0.0) -> str:
    return f"coalesce({name}, {default}D)"


def _mean(pairs: Iterable[tuple[float | str, str]]) -> str:
    """Weighted mean over terms that are never null; weights are numbers or columns."""
    terms = [(w if isinstance(w, str) else f"{w!r}D", v) for w, v in pairs]
    return f"({' + '.join(f'{w} * {v}' for w, v in terms)}) / ({' + '.join(w for w, _ in terms)})"


def _ladder(value: str, steps: Iterable[tuple[float, str]], otherwise: str) -> str:
    return f"case {' '.join(f'when {value} >= {floor} then {out}' for floor, out in steps)} else {otherwise} end"


def _add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Append columns given as expression text, all seeing the same input."""
    return df.selectExpr("*", *[f"{text} as {name}" for name, text in columns.items()])


def _borough_has(text: str) -> str:
    return f"contains(lower(coalesce(borough_name, '')), '{text}')"


CORE_GUARD = (
    f"({_borough_has('manhattan')} and coalesce(centroid_latitude, 999.0D) <= {CORE_LATITUDE}D "
    f"and zone_id not in ({', '.join(map(str, CORRIDOR_ZONE_IDS))}))"
)


def core_guard() -> Column:
    return F.expr(CORE_GUARD)


def with_busy_base(df: DataFrame) -> DataFrame:
    support = "greatest(demand_now_n, demand_next_n)"
    df = _add(df, {"demand_support_n": support, "density_support_n": _clip(f"0.20D + 0.80D * {support}")})
    df = _add(df, {
        "effective_density_now_n": "density_now_n * density_support_n",
        "effective_density_next_n": "density_next_n * density_support_n",
    })
    return _add(df, {
        "busy_now_n": _clip("0.68D * demand_now_n + 0.32D * effective_density_now_n"),
        "busy_next_n": _clip("0.62D * demand_next_n + 0.38D * effective_density_next_n"),
    })


def with_saturation(df: DataFrame) -> DataFrame:
    pressure = _clip(
        "0.30D * effective_density_now_n + 0.15D * demand_support_n + 0.18D * short_trip_n"
        f" + 0.16D * {_nvl('same_zone_n')} + 0.11D * (1D - {_nvl('pay_per_mile_n', 0.5)})"
        " + 0.10D * (1D - downstream_n)")
    cases = " ".join(f"when {_borough_has(name)} then {value}D" for name, value in BOROUGH_MULTIPLIERS)
    df = _add(df, {"market_pressure_n": pressure,
                   "borough_multiplier": f"case {cases} else {OTHER_BOROUGH_MULTIPLIER}D end"})
    return _add(df, {"market_saturation_n": _clip("market_pressure_n * borough_multiplier")})


def with_churn(df: DataFrame) -> DataFrame:
    excess = "greatest(density_now_n - greatest(demand_next_n, downstream_n), 0D)"
    return _add(df, {"churn_pressure_n": _clip(
        f"0.45D * {_nvl('same_zone_n')} + 0.35D * short_trip_n + 0.20D * {excess}")})


def with_core_features(df: DataFrame) -> DataFrame:
    """Features that apply only to the core of Manhattan; neutral elsewhere."""
    def core(text: str, neutral: float = 0.0) -> str:
        return f"case when {CORE_GUARD} then {text} else {neutral}D end"

    excess = "greatest(density_now_n - greatest(downstream_n, busy_next_n), 0D)"
    df = _add(df, {"core_saturation_n": core("churn_pressure_n")})
    return _add(df, {
        "core_discount": core(_clip("1D - 0.14D * core_saturation_n", 0.86, 1.0), 1.0),
        "core_trap_n": core(_clip(f"0.52D * short_trip_n + 0.30D * {_nvl('same_zone_n')} + 0.18D * {excess}")),
        "core_escape_n": core(_clip(f"0.52D * {_nvl('balanced_trip_n')} + 0.28D * {_nvl('long_trip_n')}"
                                    " + 0.20D * downstream_n")),
    })


def with_risk_and_escape(df: DataFrame) -> DataFrame:
    df = _add(df, {"return_risk": _clip(
        f"0.24D * short_trip_n + 0.20D * {_nvl('same_zone_n')} + 0.18D * {_nvl('airport_exit_n')}"
        f" + 0.18D * {_nvl('out_of_network_n')} + 0.14D * {_nvl('short_external_8mi_n')}"
        f" - 0.10D * {_nvl('long_external_n')} - 0.10D * downstream_n")})
    return _add(df, {"escape_quality": _clip(
        f"0.42D * downstream_n + 0.18D * {_nvl('long_external_n')} + 0.16D * {_nvl('pay_per_min_n')}"
        f" + 0.12D * {_nvl('pay_per_mile_n')} - 0.12D * return_risk")})


def v2_raw(profile: str) -> str:
    now, nxt, pay, per_min, per_mile, down, short, friction, shared = V2_WEIGHTS[profile]
    positive = _mean([
        (now, "demand_now_n"), (nxt, "demand_next_n"), (pay, _nvl("pay_n", 0.5)),
        (per_min, _nvl("pay_per_min_n", 0.5)), (per_mile, _nvl("pay_per_mile_n", 0.5)), (down, "downstream_n"),
    ])
    return _clip(f"{positive} - ({short}D * short_trip_n + {friction}D * pickup_friction_n + {shared}D * shared_ride_n)")


def _v3(profile: str) -> dict[str, float]:
    return dict(zip(V3_KEYS, V3_WEIGHTS[profile]))


def v3_positive(profile: str, balanced: str | None = None, long: str | None = None) -> str:
    w = _v3(profile)
    return _mean([
        (f"({w['demand_now']}D + {w['density_now']}D)", "busy_now_n"),
        (f"({w['demand_next']}D + {w['density_next']}D)", "busy_next_n"),
        (w["pay"], _nvl("pay_n", 0.5)), (w["pay_per_min"], _nvl("pay_per_min_n", 0.5)),
        (w["pay_per_mile"], _nvl("pay_per_mile_n", 0.5)),
        (balanced or w["balanced"], _nvl("balanced_trip_n")), (long or w["long"], _nvl("long_trip_n")),
        (w["downstream"], "downstream_n"),
    ])


def v3_negative(profile: str, saturation: str | None = None) -> str:
    w = _v3(profile)
    core = " + 0.10D * core_saturation_n" if profile == "manhattan_v3" else ""
    return (f"({w['short']}D * short_trip_n + {w['same_zone']}D * {_nvl('same_zone_n')}"
            f" + {w['friction']}D * pickup_friction_n + {w['shared']}D * shared_ride_n"
            f" + {saturation or str(w['saturation']) + 'D'} * market_saturation_n{core})")


def with_citywide_score(df: DataFrame) -> DataFrame:
    """Two passes: a first rating selects the mix and saturation weights of the second."""
    # The core features are 0 outside the core, so no guard is needed here.
    bonus = "0.045D * core_escape_n"
    malus = "(0.100D * core_saturation_n + 0.110D * core_trap_n)"
    df = _add(df, {"citywide_pre_tier_raw": _clip(
        f"{v3_positive('citywide_v3')} + {bonus} - {v3_negative('citywide_v3')} - {malus}")})
    df = _add(df, {"citywide_pre_tier_rating": "cast(round(1 + 99 * round(citywide_pre_tier_raw, 9)) as int)"})
    names = ("citywide_balanced_weight", "citywide_long_weight", "citywide_saturation_weight")
    df = _add(df, {
        name: _ladder("citywide_pre_tier_rating", [(t[0], f"{t[i + 1]}D") for t in CITYWIDE_TIERS],
                      f"{CITYWIDE_TIER_BOTTOM[i]}D")
        for i, name in enumerate(names)})
    return _add(df, {"raw_citywide_v3": _clip(
        f"{v3_positive('citywide_v3', names[0], names[1])} + {bonus} - {v3_negative('citywide_v3', names[2])} - {malus}")})


def with_raw_scores(df: DataFrame) -> DataFrame:
    columns = {f"raw_{p}": v2_raw(p) for p in V2_WEIGHTS}
    columns.update({f"raw_{p}": _clip(f"{v3_positive(p)} - {v3_negative(p)}") for p in V3_WEIGHTS if p != "citywide_v3"})
    return _add(with_citywide_score(df), columns)


def with_confidence(df: DataFrame, min_trips: int = MIN_TRIPS) -> DataFrame:
    """Confidence per profile and the score discounted by it."""
    df = _add(df, {
        "support_strength": _clip(f"pickups_now / {min_trips}"),
        "confidence_base": "least(1D, pickups_now / 40D) * (0.70D + 0.30D * downstream_coverage)",
    })
    confidence = {f"confidence_{p}": "confidence_base * support_strength" for p in V2_WEIGHTS}
    for p, (base, other, name) in CONFIDENCE_BLEND.items():
        confidence[f"confidence_{p}"] = f"{_clip(f'{base}D * confidence_base + {other}D * {_nvl(name)}')} * support_strength"
    df = _add(df, confidence)
    return _add(df, {
        f"score_{p}": _clip(f"raw_{p} * confidence_{p}" + (" * core_discount" if p == "citywide_v3" else ""))
        for p in (*V2_WEIGHTS, *V3_WEIGHTS)})


def with_trap_candidates(df: DataFrame) -> DataFrame:
    """Candidate score, confidence and delta per v3 profile."""
    scores, rest = {}, {}
    for p, (risk, airport, external, escape, good, low, high) in TRAP_FACTORS.items():
        factor = _clip(
            f"1D - {risk}D * return_risk - {airport}D * {_nvl('airport_exit_n')}"
            f" - {external}D * {_nvl('short_external_8mi_n')} + {escape}D * escape_quality"
            f" + {good}D * {_nvl('long_external_n')}", low, high)
        scores[f"score_{p}_candidate"] = _clip(f"score_{p} * {factor}")
        blend = _clip(f"0.82D * confidence_{p} + 0.18D * (1D - return_risk + escape_quality) / 2D")
        rest[f"confidence_{p}_candidate"] = f"{blend} * support_strength"
        rest[f"delta_{p}"] = f"score_{p}_candidate - score_{p}"
    return _add(_add(df, scores), rest)


FAMILIES = (*V2_WEIGHTS, *V3_WEIGHTS, *[f"{p}_candidate" for p in V3_WEIGHTS])


def with_ratings(df: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Rating, bucket and colour of every score family.

    Scores are rounded to nine places first: a rating at .5 must not turn on the last bit.
    """
    df = _add(df, {f"rating_{f}": f"cast(round(1 + 99 * round(score_{f}, 9)) as int)" for f in families})
    labels = {}
    for f in families:
        labels[f"bucket_{f}"] = _ladder(f"rating_{f}", [(r[0], f"'{r[1]}'") for r in RATING_LADDER], f"'{RATING_BOTTOM[0]}'")
        labels[f"color_{f}"] = _ladder(f"rating_{f}", [(r[0], f"'{r[2]}'") for r in RATING_LADDER], f"'{RATING_BOTTOM[1]}'")
    return _add(df, labels)


def score_components(df: DataFrame) -> DataFrame:
    """The addends of every v3 score: four positives and four penalties per profile."""
    out = []
    for p in V3_WEIGHTS:
        w, city = _v3(p), p == "citywide_v3"
        balanced, long, saturation = (
            ("citywide_balanced_weight", "citywide_long_weight", "citywide_saturation_weight") if city
            else (f"{w['balanced']}D", f"{w['long']}D", f"{w['saturation']}D"))
        mix = f"{balanced} * {_nvl('balanced_trip_n')} + {long} * {_nvl('long_trip_n')}"
        market = f"{saturation} * market_saturation_n"
        if city:
            mix += " + 0.045D * core_escape_n"
            market += " + 0.100D * core_saturation_n + 0.110D * core_trap_n"
        if p == "manhattan_v3":
            market += " + 0.10D * core_saturation_n"
        out += [
            f"({w['demand_now']}D + {w['density_now']}D) * busy_now_n"
            f" + ({w['demand_next']}D + {w['density_next']}D) * busy_next_n as busy_{p}",
            f"{w['pay']}D * {_nvl('pay_n', 0.5)} + {w['pay_per_min']}D * {_nvl('pay_per_min_n', 0.5)}"
            f" + {w['pay_per_mile']}D * {_nvl('pay_per_mile_n', 0.5)} as pay_{p}",
            f"{mix} as mix_{p}",
            f"{w['downstream']}D * downstream_n as continuation_{p}",
            f"{w['short']}D * short_trip_n as short_penalty_{p}",
            f"{w['same_zone']}D * {_nvl('same_zone_n')} as retention_penalty_{p}",
            f"{w['friction']}D * pickup_friction_n + {w['shared']}D * shared_ride_n as friction_penalty_{p}",
            f"{market} as saturation_penalty_{p}",
        ]
    return df.selectExpr("zone_id", "bin_local_epoch", *out)


def with_features(ranked: DataFrame) -> DataFrame:
    return with_risk_and_escape(with_core_features(with_churn(with_saturation(with_busy_base(ranked)))))


def with_scores(ranked: DataFrame, min_trips: int = MIN_TRIPS) -> DataFrame:
    return with_trap_candidates(with_confidence(with_raw_scores(with_features(ranked)), min_trips))
