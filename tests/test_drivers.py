"""Business days, battles, levels and games with literal expectations."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rideops.functions import times
from rideops.operators import battles as b, drivers as d

NY = "America/New_York"


def _epoch(y, m, day, hour, minute=0, second=0):
    from zoneinfo import ZoneInfo
    return int(datetime.datetime(y, m, day, hour, minute, second, tzinfo=ZoneInfo(NY)).timestamp())


@pytest.mark.parametrize("day", [(2025, 1, 7), (2025, 3, 9), (2025, 11, 2)])
def test_split_at_four_local(spark, day):
    four = _epoch(*day, 4)
    beats = spark.createDataFrame([(1, 1, four - 100, 40.70, -73.98), (2, 1, four + 140, 40.71, -73.98)],
                                  "event_id long, user_id long, at long, lat double, lng double")
    rows = {str(r.nyc_date): r for r in d.split_by_business_day(d.heartbeat_segments(beats)).collect()}
    today = datetime.date(*day)
    before = str(today - datetime.timedelta(days=1))
    assert (rows[before].seconds, rows[str(today)].seconds) == (100, 140)
    total = rows[before].split_miles + rows[str(today)].split_miles
    assert total == pytest.approx(rows[before].counted_miles)


def test_gap_cap_and_implausible_speed(spark):
    beats = spark.createDataFrame(
        [(1, 1, 0, 40.70, -73.98), (2, 1, 1000, 40.72, -73.98), (3, 1, 1010, 41.72, -73.98), (4, 1, 1020, 41.72, -73.98), (5, 1, 1020, 41.0, -73.98)],
        "event_id long, user_id long, at long, lat double, lng double")
    seconds = {r.event_id: r.counted_seconds for r in d.heartbeat_segments(beats).collect()}
    assert seconds == {1: 0, 2: 300, 3: 0, 4: 0, 5: 0}


def test_local_epoch_across_dst(spark):
    row = spark.range(1).select(
        times.local_epoch(F.lit(_epoch(2025, 3, 9, 3))).alias("a"), times.local_epoch(F.lit(_epoch(2025, 3, 9, 1))).alias("b")).collect()[0]
    assert row.a - row.b == 7200  # the wall clock skips an hour


def _stats(spark, rows):
    return spark.createDataFrame(rows, "user_id long, nyc_date date, miles_worked double, hours_worked double, pickups_recorded long")


def _battle(spark, a0, b0):
    day = datetime.date(2025, 1, 6)
    return spark.createDataFrame([(1, "miles", "daily", 10, 20, "active", day, day, 0, 5, 100, a0, b0)],
                                 "battle_id long, metric string, period string, challenger_id long, challenged_id long, status string, start_date date, "
                                 "end_date date, created_at long, expires_at long, ends_at long, challenger_start double, challenged_start double")


@pytest.mark.parametrize("a,a0,b_,b0,result,values", [(31.0, 20.0, 14.0, 10.0, "challenger_win", (11.0, 4.0)), (5.0, 2.0, 4.0, 1.0, "tie", (3.0, 3.0)),
                                                      (1.0, 2.0, 4.0, 1.0, "challenged_win", (0.0, 3.0))])
def test_battle_settlement(spark, a, a0, b_, b0, result, values):
    day = datetime.date(2025, 1, 6)
    stats = _stats(spark, [(10, day, a, 0.0, 0), (20, day, b_, 0.0, 0), (10, day + datetime.timedelta(days=1), 99.0, 0.0, 0)])
    row = b.battle_settlement(_battle(spark, a0, b0), stats, 100).collect()[0]
    assert (row.result_code, row.challenger_value, row.challenged_value) == (result, *values)
    assert b.battle_settlement(_battle(spark, a0, b0), stats, 99).count() == 0


def test_level_edges(spark):
    levels = {r.level: r.xp for r in d.level_thresholds(spark).collect()}
    assert len(levels) == 1000 and levels[1] == 0 and levels[2] == 153
    edges = [(x, lvl) for lvl in (1, 100, 101, 999, 1000) for x in (levels[lvl],)]
    rows = [(x,) for x, _ in edges] + [(levels[100] - 1,), (levels[1000] + 5,)]
    got = [r.level for r in d.with_level(spark.createDataFrame(rows, "total_xp long")).orderBy("total_xp").collect()]
    assert sorted(got) == [1, 99, 100, 101, 999, 1000, 1000]


def test_xp_rounds_per_day_and_caps_pickups(spark):
    day = datetime.date(2025, 1, 6)
    stats = _stats(spark, [(1, day, 0.06, 0.01, 30), (1, day + datetime.timedelta(days=1), 0.06, 0.01, 2)])
    row = d.progression(stats).collect()[0]
    assert (row.miles_xp, row.hours_xp, row.report_xp) == (0, 0, 540)


MATCH = "match_id long, status string, winner_id long, loser_id long, winner_xp_awarded long, loser_xp_awarded long"


def test_game_awards_once(spark):
    rows = [(1, "completed", 10, 20, 60, 0), (1, "completed", 10, 20, 60, 0), (2, "forfeited", 20, 10, 45, 5), (3, "active", 10, 20, 60, 0), (4, "completed", 30, None, None, 7)]
    got = {(r.match_id, r.user_id, r.xp_awarded) for r in b.game_xp(spark.createDataFrame(rows, MATCH)).collect()}
    assert got == {(1, 10, 60), (1, 20, 0), (2, 20, 45), (2, 10, 5), (4, 30, 0)}


def test_period_report_goes_to_those_who_want_it(spark):
    day = datetime.date(2025, 5, 7)
    stats = _stats(spark, [(1, day, 9.0, 1.0, 3), (2, day, 5.0, 2.0, 1), (3, day, 7.0, 9.0, 1), (9, datetime.date(2025, 6, 1), 50.0, 9.0, 1)])
    users = spark.createDataFrame([(1, "a@x", None), (2, "b@x", "B"), (3, " ", "C"), (4, "d@x", "D"), (5, "e@x", "E"), (6, None, "F"), (9, "i@x", "I")],
                                  "user_id long, email string, display_name string").withColumns({"is_disabled": F.lit(False), "is_suspended": F.lit(False)})
    prefs = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True), (5, None), (6, True), (9, True)], "user_id long, monthly_enabled boolean")
    sent = spark.createDataFrame([(4, "monthly", "2025-04"), (9, "monthly", "2025-05"), (1, "weekly", "2025-05")], "user_id long, report_type string, period_key string")
    out = d.period_report(stats, users, sent, F.lit("2025-06-18").cast("date"), "monthly", prefs).collect()
    got = {r.user_id: (r.miles, r.pickups, r.miles_rank, r.hours_rank, r.badge_code) for r in out}
    assert got == {1: (9.0, 3, 1, 3, "crown"), 4: (0.0, 0, None, None, None)}


def test_expiry_boundary(spark):
    df = spark.createDataFrame([("pending", 10), ("active", 10)], "status string, expires_at long")
    assert [r.status for r in b.expire_pending(df, 10).collect()] == ["expired", "active"]
    assert [r.status for r in b.expire_pending(df, 10, inclusive=False).collect()] == ["pending", "active"]


def test_battle_totals_equal_days_between(spark):
    """One user has half of all battles; borders on days without work, empty and reversed periods."""
    rng = random.Random(2)
    first = datetime.date(2024, 11, 1)
    days = [(u, first + datetime.timedelta(days=k), rng.randint(0, 9) / 8, rng.randint(0, 4) / 4) for u in (1, 2, 3) for k in range(200) if rng.random() < 0.6]
    rows = []
    for i in range(80):
        start = first + datetime.timedelta(days=rng.randint(-5, 210))
        rows.append((i, rng.choice(["miles", "hours", "other"]), 1, rng.choice([2, 3, 4]), start, start + datetime.timedelta(days=rng.choice([-1, 0, 6, 29, 100])), rng.choice([None, 1.5]), 0.0))
    battles = spark.createDataFrame(rows, "battle_id long, metric string, challenger_id long, challenged_id long, start_date date, end_date date, challenger_start double, challenged_start double")
    got = {r.battle_id: (r.challenger_value, r.challenged_value) for r in b.side_totals(battles, spark.createDataFrame(days, "user_id long, nyc_date date, miles_worked double, hours_worked double")).collect()}

    def total(row, user, start):
        col = {"miles": 2, "hours": 3}.get(row[1])
        return max(round(round(sum(d[col] for d in days if col and d[0] == user and row[4] <= d[1] <= row[5]), 4) - (start or 0), 4), 0)

    assert got == {r[0]: (total(r, r[2], r[6]), total(r, r[3], r[7])) for r in rows}
