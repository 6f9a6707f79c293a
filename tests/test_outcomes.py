"""Claims, brackets, guard and guidance against brute force and literal cases."""

import random

from rideops.operators import guidance as g, outcomes as o
from rideops.streaming import jobs

REC = "recommendation_id long, user_id long, zone_id int, recommended_at long, center_lat double, center_lng double"
PICK = "pickup_id long, user_id long, zone_id int, created_at long, lat double, lng double"


def _brute(recs, picks, limit, fallback):
    open_, out = list(recs), set()
    for p in sorted(picks, key=lambda r: (r[3], r[0])):
        near = [r for r in open_ if r[1] == p[1] and r[2] == p[2] and p[3] - 5400 <= r[3] <= p[3]]
        scored = [(round(o.miles_between(p[4], p[5], r[4], r[5]), 9), -r[3], -r[0], r) for r in near]
        good = sorted(s for s in scored if s[0] <= limit)
        pick = good[0][3] if good else max(near, key=lambda r: (r[3], r[0])) if fallback and near else None
        if pick:
            open_.remove(pick)
            out.add((p[0], pick[0]))
    return out


def _random_case(seed):
    rng = random.Random(seed)

    def spot():
        return 40.70 + rng.randint(0, 12) / 1000, -73.98 + rng.randint(0, 12) / 1000

    recs = [(i, 1 if rng.random() < 0.7 else 2, rng.randint(1, 2), rng.randint(0, 90_000), *spot()) for i in range(160)]
    picks = [(i, 1 if rng.random() < 0.7 else 2, rng.randint(1, 2), rng.randint(0, 90_000), *spot()) for i in range(90)]
    return recs, picks


def test_claims_match_brute_force(spark):
    recs, picks = _random_case(3)
    r, p = spark.createDataFrame(recs, REC), spark.createDataFrame(picks, PICK)
    for fn, limit, fallback in ((o.settle_hotspot_outcomes, 0.35, True), (o.settle_micro_outcomes, 0.20, False)):
        rows = fn(r, p).collect()
        assert {(x.pickup_id, x.recommendation_id) for x in rows} == _brute(recs, picks, limit, fallback)
        assert len({x.recommendation_id for x in rows}) == len(rows)


def test_claims_of_a_user_who_never_pauses(spark):
    """Half of all rows are one user's, an event every minute for days, at every border of the buckets."""
    rng = random.Random(8)
    recs = [(i, 1, 1, 60 * i + rng.randint(0, 3), 40.70 + rng.randint(0, 9) / 1000, -73.98) for i in range(3000)]
    picks = [(i, 1, 1, rng.choice([300 * i, 5400 * (i // 18) + rng.choice([-1, 0, 1, 5399])]), 40.70 + rng.randint(0, 9) / 1000, -73.98) for i in range(500)]
    more = [(10_000 + i, 2 + i % 700, 1, rng.randint(0, 180_000), 40.70, -73.98) for i in range(3000)]
    lone = [(10_000 + i, 2 + i % 700, 1, rng.randint(0, 180_000), 40.70, -73.98) for i in range(500)]
    r, p = spark.createDataFrame(recs + more, REC), spark.createDataFrame(picks + lone, PICK)
    for fn, limit, fallback in ((o.settle_hotspot_outcomes, 0.35, True), (o.settle_micro_outcomes, 0.20, False)):
        got = {(x.pickup_id, x.recommendation_id) for x in fn(r, p).collect()}
        assert got == _brute(recs, picks, limit, fallback) | _brute(more, lone, limit, fallback)


def test_rows_without_a_place_or_time(spark):
    r = spark.createDataFrame([(1, 7, 1, 100, None, None), (2, 7, 1, None, 40.70, -73.98), (3, None, 1, 100, 40.70, -73.98)], REC)
    p = spark.createDataFrame([(11, 7, 1, 200, 40.70, -73.98), (12, None, 1, 200, 40.70, -73.98), (13, 7, None, 200, None, None)], PICK)
    assert [(x.pickup_id, x.recommendation_id, x.spatial) for x in o.settle_hotspot_outcomes(r, p).collect()] == [(11, 1, False)]
    assert o.settle_micro_outcomes(r, p).count() == 0


def test_two_pickups_compete(spark):
    r = spark.createDataFrame([(1, 7, 1, 100, 40.70, -73.98)], REC)
    p = spark.createDataFrame([(11, 7, 1, 200, 40.70, -73.98), (12, 7, 1, 300, 40.70, -73.98), (13, 7, 1, 9000, 40.70, -73.98)], PICK)
    rows = o.settle_hotspot_outcomes(r, p).collect()
    assert [(x.pickup_id, x.recommendation_id, x.spatial) for x in rows] == [(11, 1, True)]


def test_equal_distance_takes_the_newer(spark):
    r = spark.createDataFrame([(1, 7, 1, 100, 40.70, -73.98), (2, 7, 1, 150, 40.70, -73.98)], REC)
    p = spark.createDataFrame([(11, 7, 1, 200, 40.701, -73.98)], PICK)
    assert o.settle_micro_outcomes(r, p).collect()[0].recommendation_id == 2


def test_guidance_matches_brute_force(spark):
    rng = random.Random(5)
    guidance = [(i, rng.randint(1, 3), rng.randint(0, 30_000), rng.choice(["hold", "move_nearby"]), 1, 2) for i in range(120)]
    picks = [(i, rng.randint(1, 3), rng.randint(1, 2), rng.randint(0, 30_000), 0.0, 0.0) for i in range(130)]
    want = set()
    open_ = list(guidance)
    for p in sorted(picks, key=lambda r: (r[3], r[0])):
        mine = [x for x in open_ if x[1] == p[1] and x[2] <= p[3]]
        if mine:
            best = max(mine, key=lambda x: (x[2], x[0]))
            open_.remove(best)
            want.add((p[0], best[0]))
    df = spark.createDataFrame(guidance, "guidance_id long, user_id long, recommended_at long, action string, source_zone_id int, target_zone_id int")
    rows = o.settle_guidance_outcomes(df, spark.createDataFrame(picks, PICK)).collect()
    assert {(x.pickup_id, x.guidance_id) for x in rows} == want


def test_guidance_reasons(spark):
    cases = [("move_nearby", 2, "trip_after_move_target_zone_match", True), ("micro_reposition", 3, "trip_after_move_detected", True),
             ("move_nearby", 1, "trip_without_material_move", False), ("hold", 1, "trip_while_holding_zone", False),
             ("wait_dispatch", 3, "trip_after_hold_with_relocation", True)]
    gd = spark.createDataFrame([(i, i, 10, a, 1, 2) for i, (a, *_) in enumerate(cases)],
                               "guidance_id long, user_id long, recommended_at long, action string, source_zone_id int, target_zone_id int")
    p = spark.createDataFrame([(i, i, z, 70, 0.0, 0.0) for i, (_, z, *_) in enumerate(cases)], PICK)
    got = {r.user_id: (r.settlement_reason, r.moved_before_trip, r.minutes_to_trip) for r in o.settle_guidance_outcomes(gd, p).collect()}
    assert got == {i: (reason, moved, 1.0) for i, (_, _, reason, moved) in enumerate(cases)}


def test_guard_fold(spark):
    beats = [(1, 1, t, 40.70 + t / 20_000, -73.98) for t in range(0, 500, 60)]
    hb = spark.createDataFrame(beats, "event_id long, user_id long, at long, lat double, lng double")
    tries = [(1, 1, 1, 100, 40.705, -73.98), (2, 1, 1, 440, 40.722, -73.98), (3, 1, 1, 470, 40.722, -73.98), (4, 1, 1, 2000, 40.722, -73.98), (5, 1, 1, 2100, 40.74, -73.98)]
    rows = g.pickup_guard(hb, spark.createDataFrame(tries, PICK)).filter("kind = 1").orderBy("event_id").collect()
    assert [r.decision for r in rows] == ["pickup_needs_recent_driving", "driving_evidence", "pickup_cooldown_active", "pickup_same_position",
                                          "relocated_from_last_accepted_trip"]


def _walk(beats, tries):
    """The guard one event after the other, voids included."""
    events = sorted([(b[2], 0, b[0], b[1], b[3], b[4], None) for b in beats] + [(t[4], 1, t[0], t[1], t[5], t[6], t[7]) for t in tries])
    states, out = {}, []
    for at, kind, event_id, user, lat, lng, voided_at in events:
        s, taken = states.setdefault(user, (g.GuardState(), []))
        decision = None
        if kind == 0:
            s.heartbeat(at, lat, lng)
        else:
            valid = [x for x in taken if x[3] is None or x[3] > at]
            decision, ok = g.verdict(at, lat, lng, s.session_end, s.streak, valid[-1][:3] if valid else None)
            if ok:
                taken.append((at, lat, lng, voided_at))
        out.append((user, at, kind, event_id, decision, s.session_end and s.session_end[0], *s.streak))
    return sorted(out, key=str)


def test_guard_equals_a_walk_with_half_of_the_rows_one_driver(spark):
    """Standing, driving, breaks, ties and hours without a heartbeat; a bucket's border may fall anywhere."""
    rng = random.Random(11)
    beats, tries, at, lat = [], [], {1: 0, 2: 0, 3: 500}, {1: 40.7, 2: 40.7, 3: 40.7}
    for i in range(2400):
        user = 1 if i % 2 else rng.choice([2, 3])
        at[user] += rng.choice([0, 10, 60, 60, 60, 100, 179, 181, 200, 480, 481, 2000 if rng.random() < 0.2 else 60])
        lat[user] += rng.choice([0, 0, 0, 0.0005, 0.001, 0.004])
        beats.append((i, user, at[user], lat[user], -73.98))
        if rng.random() < 0.15:
            when = at[user] + rng.choice([0, 1, 5000 if rng.random() < 0.1 else 30])
            tries.append((i, user, 1, 1, when, lat[user] + rng.choice([0, 0.0005, 0.003]), -73.98, when + rng.choice([1, 500, 5000]) if rng.random() < 0.4 else None))
    hb = spark.createDataFrame(beats, "event_id long, user_id long, at long, lat double, lng double")
    tr = spark.createDataFrame(tries, "pickup_id long, user_id long, zone_id int, x int, created_at long, lat double, lng double, voided_at long")
    for bucket in (600, 3600):
        rows = g.pickup_guard(hb, tr, bucket).collect()
        got = sorted(((r.user_id, r.at, r.kind, r.event_id, r.decision, r.previous_session_end_at, r.movement_streak_started_at, r.last_meaningful_motion_at) for r in rows), key=str)
        assert got == _walk(beats, tries)
    assert len({r.decision for r in rows}) == 7


def test_void_between_two_attempts_changes_the_second(spark):
    hb = spark.createDataFrame([(t, 1, t, 40.70 + t / 20_000, -73.98) for t in range(0, 500, 60)], "event_id long, user_id long, at long, lat double, lng double")

    def decisions(voided_at):
        tries = [(1, 1, 1, 480, 40.724, -73.98, None), (2, 1, 1, 1200, 40.730, -73.98, voided_at), (3, 1, 1, 2000, 40.730, -73.98, None)]
        out = g.pickup_guard(hb, spark.createDataFrame(tries, PICK + ", voided_at long")).filter("kind = 1").orderBy("event_id").collect()
        return [r.decision for r in out]

    moved = ["driving_evidence", "relocated_from_last_accepted_trip"]
    assert decisions(None) == decisions(2001) == [*moved, "pickup_same_position"]
    assert decisions(1500) == decisions(2000) == [*moved, "relocated_from_last_accepted_trip"]


def test_guard_session_break():
    s = g.GuardState()
    s.heartbeat(0, 40.70, -73.98)
    s.heartbeat(60, 40.71, -73.98)
    assert s.streak == (0, 60)
    s.heartbeat(540, 40.71, -73.98)          # a gap of exactly 480 s is no break, but the motion is stale
    assert s.session_end is None and s.streak == (None, None)
    s.heartbeat(1021, 40.71, -73.98)
    assert s.session_end[0] == 540


def _guide(spark, **over):
    base = dict(rating=60, next_rating=60, continuation=0.2, tripless_minutes=30.0, stationary_minutes=2.0, movement_minutes=30.0, move_attempts=0,
                trips_60m=0, moved_since_trip=False, dispatch_uncertainty=0.3, best_rating=None, best_distance=None, last_action=None, last_move_at=None)
    base.update(over)
    df = spark.createDataFrame([tuple(base.values())], "rating int, next_rating int, continuation double, tripless_minutes double, stationary_minutes double, "
                               "movement_minutes double, move_attempts int, trips_60m int, moved_since_trip boolean, dispatch_uncertainty double, best_rating int, "
                               "best_distance double, last_action string, last_move_at long")
    return g.guidance_action(df, 10_000).collect()[0]


def test_guidance_rules(spark):
    assert _guide(spark, rating=70, next_rating=68, continuation=0.6, tripless_minutes=10.0).reason_codes[0] == "zone_still_strong"
    assert _guide(spark, moved_since_trip=True, move_attempts=1, dispatch_uncertainty=0.6).action == "wait_dispatch"
    assert _guide(spark, stationary_minutes=20.0).action == "micro_reposition"
    assert _guide(spark, rating=40, next_rating=41, best_rating=60, best_distance=1.0).action == "move_nearby"
    cooling = _guide(spark, rating=40, next_rating=41, best_rating=60, best_distance=1.0, last_action="move_nearby", last_move_at=9_900)
    assert (cooling.action, cooling.hold_until) == ("wait_dispatch", 10_560)
    assert _guide(spark).reason_codes == ["default_hold_bias"]


def test_modifier_is_neutral_below_six(spark):
    df = spark.createDataFrame([(1, True, 5.0, 0.1, 100)] * 5 + [(2, True, 2.0, 0.01, 100)] * 12, "zone_id int, converted_to_trip boolean, minutes_to_trip double, distance_miles double, recommended_at long")
    got = {r.zone_id: r.modifier for r in o.outcome_modifier(df, ["zone_id"], 200).collect()}
    assert got == {1: 1.0, 2: 1.22}


class _Clock(int):
    """A time that counts how often it is compared with others."""

    asked = 0

    def __sub__(self, other):
        _Clock.asked += 1
        return int(self) - other


def test_settlement_looks_once_at_each_recommendation_to_expire_it():
    rows = [(_Clock(10 + i), 0, i, 40.7, -73.9) for i in range(2000)]
    kept = []
    out = list(jobs.SettlementProcessor(0.35, True).take((1, 2), kept, rows, 5400 + 1010.0))
    assert [r[2] for r in out] == list(range(1000)) and [r[1] for r in kept] == list(range(1000, 2000))
    assert _Clock.asked < 3 * len(rows)


def test_pickups_among_many_open_recommendations(monkeypatch):
    """The same claims as when every open one is measured, and few are."""
    asked, exact = [], o.miles_between
    monkeypatch.setattr(o, "miles_between", lambda *places: asked.append(1) or exact(*places))
    for seed, fallback in ((1, True), (2, False)):
        rng = random.Random(seed)

        def spot():
            return (None, -73.98) if rng.random() < 0.1 else (40.70 + rng.randint(0, 60) / 3000, -73.98 + rng.randint(0, 60) / 3000)

        rows = sorted((rng.randint(0, 12_000), int(rng.random() < 0.3), i // 2, *spot()) for i in range(4000))
        plain, held, measured, whole = [], o.OpenRecs(), 0, 0
        for at, is_pickup, i, lat, lng in rows:
            gone = [r for r in plain if at - r[0] > 5400]
            plain = plain[len(gone):]
            assert list(held.expire(at)) == gone
            if is_pickup:
                whole += len(plain)
                want = o.best_claim(plain, at, lat, lng, 0.2, fallback)
                asked.clear()
                assert held.claim(at, lat, lng, 0.2, fallback) == want
                measured += len(asked)
                if want:
                    plain.remove(want[0])
            else:
                plain.append((at, i, lat, lng))
                held.append(plain[-1])
            assert held.open == len(plain)
        assert list(held) == plain and whole > 100_000 and measured < whole / 20
