"""Literal cases of the hotspot and presence reads that the test tables do not hold."""

import random

import pytest

from rideops.operators import community as c, hotspots as h

NOW = 1_000_000
SIDE = "zone_id int, value double"


def test_live_score_of_zones_missing_from_some_inputs(spark):
    points = spark.createDataFrame([(1, 7, NOW)], "zone_id int, user_id long, created_at long")
    history = spark.createDataFrame([(2, 52.0), (6, 52.0)], SIDE)
    slot = spark.createDataFrame([(3, 28.0)], SIDE)
    density, previous = spark.createDataFrame([(4, 5.0)], SIDE), spark.createDataFrame([(5, 1.0), (6, 1.0)], SIDE)
    got = {r.zone_id: r for r in h.live_zone_score(points, history, slot, density, previous, 0, NOW).collect()}
    assert set(got) == {1, 2, 3, 6}
    assert (got[1].unique_drivers, got[1].weighted_trip_count) == (1, 1.0) and got[2].unique_drivers == 0
    assert got[2].final_score == pytest.approx(0.495) and got[2].recommended
    assert got[6].final_score == pytest.approx(0.72 + 0.28 * 0.495)
    assert got[3].final_score == pytest.approx(0.045) and not got[3].recommended


def test_third_hotspot_needs_area_and_support(spark):
    def square(side):
        return [[[0.0, 0.0], [side, 0.0], [side, side], [0.0, side], [0.0, 0.0]]]

    shapes = spark.createDataFrame([(1, square(0.023)), (2, square(0.021)), (3, square(0.023))], "zone_id int, rings array<array<array<double>>>")
    places = ((0, 10.0, 0.0, 0.0), (1, 8.0, 2000.0, 0.0), (2, 5.0, 1000.0, 2000.0))
    support = {1: (16.0, 12.0, 10.0), 2: (16.0, 12.0, 10.0), 3: (12.0, 12.0, 10.0)}
    parts = spark.createDataFrame([(z, r, s, w[r], x, y) for z, w in support.items() for r, s, x, y in places],
                                  "zone_id int, anchor_rank int, component_score double, support_weight double, centroid_x double, centroid_y double")
    assert {r.zone_id: r.hotspot_limit for r in h.hotspot_limit(parts, shapes).collect()} == {1: 3, 2: 2, 3: 2}


def test_nearest_zone_of_any_point_equals_all_distances(spark):
    """Points inside, between and far outside the zones; cells hold few of the centroids."""
    from rideops.operators.outcomes import miles_between

    rng = random.Random(4)
    zones = [(i, 40.5 + rng.random() / 2, -74.2 + rng.random() / 2) for i in range(60)]
    rows = [(i, [[[x - 0.004, y - 0.003], [x + 0.004, y - 0.003], [x + 0.004, y + 0.003], [x - 0.004, y + 0.003], [x - 0.004, y - 0.003]]], y, x) for i, y, x in zones]
    shapes = spark.createDataFrame(rows, "zone_id int, rings array<array<array<double>>>, centroid_latitude double, centroid_longitude double")
    places = [(i, 40.4 + rng.random() * 0.7, -74.3 + rng.random() * 0.7) for i in range(800)] + [(900, 0.0, 0.0), (901, -33.9, 151.2)]
    out = h.point_to_zone(spark.createDataFrame([*places, (902, None, None)], "event_id long, lat double, lng double"), shapes)
    got = {r.event_id: r for r in out.collect()}
    for i, y, x in places:
        nearest = min((miles_between(y, x, zy, zx), z) for z, zy, zx in zones)
        inside = [z for z, zy, zx in zones if abs(x - zx) < 0.004 and abs(y - zy) < 0.003]
        assert got[i].nearest_zone_id == nearest[1] and got[i].containing_zone_id == (min(inside) if inside else None)
    assert got[902].current_zone_id is None and len(got) == 803


def test_pairs_of_zones_meet_once_wherever_cells_lie(spark):
    """Boxes over many cells, in one borough spelled three ways; one zone has no borough."""
    def square(x, y, side):
        return [[[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]]

    boxes = [(1, "Queens", 0.0, 0.0, 0.3), (2, " queens", 0.3, 0.0, 0.2), (3, "QUEENS ", 0.3002, 0.2, 0.1), (4, "Bronx", 0.0, 0.3, 0.1), (5, "", 0.1, 0.3, 0.1), (6, "Queens", 0.302, 0.302, 0.1)]
    shapes = spark.createDataFrame([(z, b, square(x, y, s)) for z, b, x, y, s in boxes], "zone_id int, borough_name string, rings array<array<array<double>>>")
    parts = spark.createDataFrame([(z, 0, 1.0, 1.0, 0.0, 0.0) for z, *_ in boxes], "zone_id int, anchor_rank int, component_score double, support_weight double, centroid_x double, centroid_y double")
    recent = spark.createDataFrame([(1, 0.0, 0.0)], "zone_id int, lat double, lng double")
    got = sorted((r.zone_id_a, r.zone_id_b, r.borough_name) for r in h.adjacent_hotspot_merge(parts, shapes, recent).collect())
    assert got == [(1, 2, "queens"), (1, 3, "queens"), (2, 3, "queens")]


def test_far_zones_of_a_borough_are_named_as_such(spark):
    def square(x):
        return [[[x, 0.0], [x + 0.1, 0.0], [x + 0.1, 0.1], [x, 0.1], [x, 0.0]]]

    boxes = [(1, "Queens", 0.0), (2, "queens ", 0.1), (3, "QUEENS", 5.0), (4, "Bronx", 0.2), (5, "", 0.0), (6, " ", 0.1)]
    shapes = spark.createDataFrame([(z, b, square(x)) for z, b, x in boxes], "zone_id int, borough_name string, rings array<array<array<double>>>")
    parts = spark.createDataFrame([(z, 0, 1.0, 1.0, 0.0, 0.0) for z, *_ in boxes], "zone_id int, anchor_rank int, component_score double, support_weight double, centroid_x double, centroid_y double")
    recent = spark.createDataFrame([(1, 0.0, 0.0)], "zone_id int, lat double, lng double")
    got = {(r.zone_id_a, r.zone_id_b): r.reason for r in h.adjacent_hotspot_merge(parts, shapes, recent, every_pair=True).collect()}
    assert got == {(1, 2): "weak_boundary_activity", (1, 3): "zone_boundary_too_far", (2, 3): "zone_boundary_too_far"}


def test_presence_of_a_deleted_account_is_removed(spark):
    presence = spark.createDataFrame([(1, NOW - 10), (2, NOW - 10), (3, NOW - 5000)], "user_id long, at long")
    users = spark.createDataFrame([(1, False, False, False, "a", "a@b"), (3, False, False, False, "c", "c@b")],
                                  "user_id long, is_disabled boolean, is_suspended boolean, ghost_mode boolean, display_name string, email string")
    got = {r.user_id: r.kind for r in c.presence_delta(presence, users, NOW, (NOW - 3600) * 1000, 900).collect()}
    assert got == {1: "item", 2: "removed"}


def test_message_cursors(spark):
    rows = [(i, "global" if i % 2 else "other", 1 if i % 5 else 2, 1_736_000_000 + 60 * i) for i in range(1, 500)]
    messages = spark.createDataFrame(rows, "message_id long, room string, user_id long, created_at long")
    users = spark.createDataFrame([(1, False, False), (2, True, False)], "user_id long, is_disabled boolean, is_suspended boolean")

    def read(limit, after=None, room="global"):
        return [r.message_id for r in c.room_messages(messages, users, room, limit, after).collect()]

    mine = [i for i in range(1, 500) if i % 2 and i % 5]
    assert read(10) == mine[-10:] and read(10, "  ") == mine[-10:] and read(10, None, " global ") == mine[-10:]
    assert read(1000) == mine[-200:] and read(0) == mine[-1:]
    assert read(7, " 100 ") == [i for i in mine if i > 100][:7]
    assert read(7, "2025-01-04T17:33:20Z") == read(7, "2025-01-04T12:33:20-05:00") == read(7, "2025-01-04T17:33:20") == [i for i in mine if i > 200][:7]
    with pytest.raises(ValueError):
        read(7, "yesterday")
    with pytest.raises(ValueError):
        read(7, None, " ")


def test_purge_names_rows_and_files(spark):
    chat = spark.createDataFrame([(1, 3, "a"), (2, 4, "b"), (3, 3, " "), (4, 3, "a"), (5, 3, None)], "message_id long, user_id long, audio_path string")
    direct = spark.createDataFrame([(1, 3, 3, "c"), (2, 3, 4, "d"), (3, 4, 3, "a"), (4, 4, 5, "e"), (5, None, 4, "f")], "message_id long, sender_id long, recipient_id long, audio_path string")
    seen = spark.createDataFrame([(1, 3), (2, 4), (3, None)], "row_id long, user_id long")
    leaving = spark.createDataFrame([(3,), (3,), (9,)], "user_id long")
    tables = {"chat": (chat, ["user_id"]), "direct": (direct, ["sender_id", "recipient_id"])}
    remaining, counts, paths = c.account_purge(tables, {"seen": (seen, "user_id")}, {"chat": ["audio_path"], "direct": ["audio_path"]}, leaving)
    assert {(r.table_name, r.what): r.rows for r in counts.collect()} == {("chat", "deleted"): 4, ("direct", "deleted"): 3, ("seen", "anonymized"): 1}
    assert sorted(r.message_id for r in remaining["direct"].collect()) == [4, 5] and [r.message_id for r in remaining["chat"].collect()] == [2]
    assert sorted((r.row_id, r.user_id) for r in remaining["seen"].collect()) == [(1, None), (2, 4), (3, None)]
    assert sorted(r.path for r in paths.collect()) == ["a", "c", "d"]
