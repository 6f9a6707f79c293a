"""Trip features, zone-bins and ranks on hand-made rows."""

import datetime

from pyspark.sql import functions as F

from rideops.operators import ranks, trip_features as tf, zone_bins as zb
from rideops.operators.medians import bucketed_medians
from rideops.plans import common, scored
from rideops.sources.trips import normalize_trips, read_trips
from tests.conftest import SF

UTC = datetime.timezone.utc


def _zones(spark, rows=((46, "City Island", "Bronx", 1.0, 40.85), (132, "JFK Airport", "Queens", 5.0, 40.64))):
    return tf.with_airport_flag(spark.createDataFrame(
        list(rows), "zone_id int, zone_name string, borough_name string, zone_area_sq_miles double, centroid_latitude double"))


def _trips(spark, pays=(30.0, 40.0)):
    at = datetime.datetime(2025, 1, 6, 17, 5, tzinfo=UTC)
    rows = [(46, 132, at, at - datetime.timedelta(minutes=3), p, 1500.0, 14.0, 0) for p in pays]
    return spark.createDataFrame(rows, "PULocationID int, DOLocationID int, pickup_datetime timestamp, request_datetime timestamp, "
                                       "driver_pay double, trip_time double, trip_miles double, shared_match_flag int")


def test_two_trips_to_an_airport(spark):
    out = scored.zone_bin_scored(normalize_trips(_trips(spark)), _zones(spark)).collect()
    assert len(out) == 1
    row = out[0]
    assert (row.zone_id, row.pickups_now, row.median_driver_pay) == (46, 2, 35.0)
    assert row.airport_exit_share == 1.0 and row.long_external_share == 1.0
    assert row.demand_now_n == 0.0  # a single zone ranks 0
    assert row.rating_citywide_v3 >= 1


def test_all_pay_null_keeps_the_row(spark):
    row = scored.zone_bin_scored(normalize_trips(_trips(spark, (None, None))), _zones(spark)).collect()[0]
    assert row.pickups_now == 2 and row.median_driver_pay is None and row.pay_n is None
    assert row.score_citywide_v3 is not None


def test_optional_columns_and_lenient_values(spark):
    df = spark.createDataFrame([(46, None, "2025-01-06 17:05:00", "oops", "60", "1")],
                               "PULocationID int, DOLocationID int, p string, driver_pay string, trip_time string, trip_miles string")
    df = df.withColumn("pickup_datetime", F.col("p").cast("timestamp_ntz"))
    row = normalize_trips(df).collect()[0]
    assert row.driver_pay is None and row.trip_time == 60.0 and row.shared_flag == 0 and row.airport_fee is None


def test_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "trips")
    _trips(spark).write.parquet(path)
    df = read_trips(spark, path, "2025-01-06 00:00:00", "2025-01-07 00:00:00")
    assert df.count() == 2
    assert read_trips(spark, path, "2025-01-07 00:00:00").count() == 0
    plan = df.select("zone_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(pickup_datetime" in plan
    assert "trip_miles" not in plan


def test_rank_ties_nulls_and_guard(spark):
    df = spark.createDataFrame(
        [(0, z, v, p) for z, v, p in ((1, 5.0, 2), (2, 5.0, 0), (3, None, 3), (4, 1.0, 4))], "bin_local_epoch long, zone_id int, v double, pickups_now int")
    out = {r.zone_id: r for r in df.withColumns({
        "all": ranks.rank_in_bin("v"), "non_null": ranks.rank_nullable("v"), "guard": ranks.demand_guard("v", "pickups_now", ranks.rank_nullable("v"))}).collect()}
    assert [round(out[z].all, 4) for z in (1, 2, 3, 4)] == [0.3333, 0.6667, 1.0, 0.0]  # ties by id, null last
    assert [out[z].non_null for z in (1, 2, 3, 4)] == [0.5, 1.0, None, 0.0]
    assert [out[z].guard for z in (1, 2, 3, 4)] == [0.5, 0.0, 0.0, 0.0]


def test_facts_equal_plain_aggregates(spark):
    prepared = common.prepared(spark, SF)
    plain = prepared.withColumn("request_min", F.when(F.col("request_min") >= 0, F.col("request_min"))).groupBy(*zb.KEYS).agg(
        F.count("*").alias("pickups_now"), *[F.round(F.median(c), 9).alias(n) for n, c in zb.MEDIANS.items()],
        *[F.avg(c).alias(n) for n, c in zb.SHARES.items()])
    facts = zb.zone_bin_agg(prepared)
    assert sorted(map(str, plain.collect())) == sorted(map(str, facts.collect()))


def test_medians_of_one_group_with_odd_values(spark):
    rows = [("a", v) for v in (3.0, -1.0, -0.0, 0.5, 1e308)] + [("b", float("nan")), ("b", 1.0), ("b", 2.0), ("c", None), ("d", 4.0), ("d", None), ("d", 5.0)]
    got = {r.k: r.v for r in bucketed_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], ["v"]).collect()}
    assert got == {"a": 0.5, "b": 2.0, "d": 4.5}  # NaN sorts last; a group without values has no row


def test_next_bin_stays_in_the_slice(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 2400, 4), (1, 21600, 9)], "zone_id int, bin_local_epoch long, pickups_now long")
    got = {r.bin_local_epoch: r.pickups_next for r in zb.next_bin_pickups(df, 6).collect()}
    assert got == {0: 4, 2400: 4, 21600: 9}
    assert {r.bin_local_epoch: r.pickups_next for r in zb.next_bin_pickups(df, None).collect()}[2400] == 9


def test_edge_shares_sum_to_one_and_next_bin_lookup(spark):
    edges = zb.od_edges(zb.od_counts(common.prepared(spark, SF)))
    bad = edges.groupBy(*zb.KEYS).agg(F.sum("edge_share").alias("s")).filter(F.abs(F.col("s") - 1) > 1e-9)
    assert bad.count() == 0
    small = spark.createDataFrame([(1, 2, 0, 1), (1, 3, 0, 1), (1, 2, 1200, 1)], "zone_id int, drop_zone_id int, bin_local_epoch long, edge_trips long")
    row = {(r.drop_zone_id, r.bin_local_epoch): r.lookup_bin for r in zb.with_lookup_bin(small, 6, "row").collect()}
    assert row == {(2, 0): 0, (3, 0): 1200, (2, 1200): None}
    later = {(r.drop_zone_id, r.bin_local_epoch): r.lookup_bin for r in zb.with_lookup_bin(small, 6, "next_bin").collect()}
    assert later == {(2, 0): 1200, (3, 0): 1200, (2, 1200): None}


def test_plan_has_no_cross_join(spark):
    plan = scored.zone_bin_facts(common.trips(spark, SF), common.zones(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_trips_are_joined_once_and_medians_do_not_shuffle_them(spark):
    joins = []
    rows = common.prepared(spark, SF)
    with scored.held_rows(rows) as held:
        want = sorted(map(str, rows.select(*zb.KEYS, "drop_zone_id", "is_network_drop", *zb.SHARES.values(), *zb.MEDIANS.values()).collect()))
        assert sorted(map(str, held.select(*zb.KEYS, "drop_zone_id", "is_network_drop", *zb.SHARES.values(), *zb.MEDIANS.values()).collect())) == want
        for df in (zb.od_counts(held), bucketed_medians(held, zb.KEYS, list(zb.MEDIANS.values()))):
            joins.append(df._jdf.queryExecution().optimizedPlan().toString())
    assert all("InMemoryRelation" in plan for plan in joins)
    assert "strategy=broadcast" in joins[1]
    assert "InMemoryRelation" not in zb.od_counts(rows)._jdf.queryExecution().optimizedPlan().toString()  # let go again


def test_medians_of_more_groups_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr("rideops.operators.medians.FEW_GROUPS", 1)
    rows = [("a", 1.0), ("a", 4.0), ("b", 7.0), (None, 3.0)]
    got = {r.k: r.v for r in bucketed_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], ["v"]).collect()}
    assert got == {"a": 2.5, "b": 7.0}
