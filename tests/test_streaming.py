"""Streaming jobs over several triggers against their batch counterparts."""

from pyspark.sql import functions as F

from rideops.operators import drivers, guidance, outcomes
from rideops.sources import adapters as a
from rideops.streaming import jobs, totals
from tests.conftest import SF


def _replay(spark, df, tmp_path, parts=3):
    """The rows in time order as a stream of several files, one per trigger."""
    path = str(tmp_path / "in")
    low, high = df.agg(F.min("at"), F.max("at")).collect()[0]
    step = (high - low) // parts + 1
    for i in range(parts):
        df.filter((F.col("at") >= low + i * step) & (F.col("at") < low + (i + 1) * step)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _shuffled(spark, df, tmp_path, parts=4):
    """The rows in random order over several triggers, and last a row of the far future, which moves the watermark past all others."""
    path = str(tmp_path / "in")
    for part in range(parts):
        df.filter(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == part).coalesce(1).write.mode("append").parquet(path)
    last = df.agg(F.max("at")).first()[0] + 400_000
    df.limit(1).withColumns({"user_id": F.lit(-1).cast("long"), "at": F.lit(last).cast("long"), "ts": F.timestamp_seconds(F.lit(last))}).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _with_ts(df):
    return df.withColumn("ts", F.timestamp_seconds("at"))


def test_daily_stats_equal_batch_and_folders_stay_few(spark, tmp_path):
    """Disorder between triggers changes nothing; every third trigger's folders are folded by date."""
    stream = _shuffled(spark, _with_ts(a.heartbeats(spark, SF)), tmp_path, 7)
    write, seen = jobs.append_daily_stats(str(tmp_path / "out"), compact_every=3), []

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)  # a replay
        seen.append(len(list((tmp_path / "out" / "batches").iterdir())))

    query = (jobs.daily_segments(stream, "1 day").writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = jobs.read_daily_stats(spark, str(tmp_path / "out"))
    want = drivers.driver_daily_stats(a.heartbeats(spark, SF))

    def rows(df):
        return sorted((r.user_id, str(r.nyc_date), round(r.miles_worked, 6), round(r.hours_worked, 6), r.heartbeat_count) for r in df.collect() if r.user_id >= 0)

    assert rows(got) == rows(want)
    assert len(seen) >= 8 and max(seen) <= 3
    assert len(list((tmp_path / "out" / "done").iterdir())) == 1
    assert all(len(list(d.iterdir())) == 1 for d in (tmp_path / "out" / "days").iterdir() if d.is_dir())


def test_a_crash_while_folding_counts_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "out")
    sums = (["user_id"], "nyc_date", ["n"])

    def put(batch_id, rows):
        df = spark.createDataFrame(rows, "user_id long, nyc_date string, n long").withColumn("nyc_date", F.col("nyc_date").cast("date"))
        totals.append_totals(path, lambda b: b, *sums, compact_every=99)(df, batch_id)

    def read():
        return sorted((r.user_id, str(r.nyc_date), r.n) for r in totals.read_totals(spark, path, *sums).collect())

    put(0, [(1, "2025-01-01", 1), (2, "2025-01-02", 5)])
    put(1, [(1, "2025-01-01", 10)])
    totals.compact(spark, path, *sums)
    put(2, [(1, "2025-01-02", 100), (2, "2025-01-02", 7)])
    want = [(1, "2025-01-01", 11), (1, "2025-01-02", 100), (2, "2025-01-02", 12)]
    assert read() == want
    # Versions written, but not committed: as after a crash in the middle.
    spark.createDataFrame([(1, 999)], "user_id long, n long").write.parquet(f"{path}/days/nyc_date=2025-01-02/upto=2")
    assert read() == want
    totals.compact(spark, path, *sums)
    assert read() == want
    put(1, [(1, "2025-01-01", 10)])  # a late replay
    assert read() == want and not list((tmp_path / "out" / "batches").iterdir())


def test_guard_equals_batch(spark, tmp_path):
    events = _with_ts(guidance.guard_events(a.heartbeats(spark, SF), a.pickups(spark, SF)))
    got = jobs.run_available(jobs.pickup_guard(_shuffled(spark, events, tmp_path), "3 days"), str(tmp_path)).filter("user_id >= 0")
    want = guidance.pickup_guard(a.heartbeats(spark, SF), a.pickups(spark, SF))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_presence_in_event_time(spark, tmp_path):
    rows = [(1, 10, 1), (2, 310, 1), (3, 700, 1), (4, 705, 1), (5, 20, 2)]
    beats = _with_ts(spark.createDataFrame(rows, "event_id long, at long, user_id long").withColumns({"lat": F.col("event_id") * 1.0, "lng": F.lit(0.0)}))
    out = jobs.run_available(jobs.presence(_shuffled(spark, beats, tmp_path), "1 hour"), str(tmp_path)).filter("user_id >= 0").collect()
    assert sorted((r.user_id, r.at, r.kind) for r in out) == [(1, 10, "item"), (1, 310, "item"), (1, 310, "stale"), (1, 700, "item"), (1, 705, "item"), (1, 705, "stale"),
                                                              (2, 20, "item"), (2, 20, "stale")]


def test_settlement_equals_batch_whatever_the_triggers(spark, tmp_path):
    rec, pick = a.recommendations(spark, SF), a.pickups(spark, SF)
    events = jobs.settlement_events(rec.withColumn("ts", F.timestamp_seconds("recommended_at")), pick.withColumn("ts", F.timestamp_seconds("created_at")))
    out = jobs.run_available(jobs.outcome_settlement(_shuffled(spark, events, tmp_path), delay="3 days"), str(tmp_path)).collect()
    want = outcomes.settle_hotspot_outcomes(rec, pick).collect()
    assert {(r.recommendation_id, r.pickup_id, r.picked_up_at) for r in out if r.converted_to_trip} == {(r.recommendation_id, r.pickup_id, r.settled_at) for r in want} and want
    assert sorted(r.recommendation_id for r in out) == sorted(r.recommendation_id for r in rec.collect())


def test_expiry_timers(spark, tmp_path):
    rows = [(1, "created", 100), (2, "created", 100), (2, "responded", 150), (3, "created", 9_000), (4, "created", 20_000)]
    df = _with_ts(spark.createDataFrame(rows, "item_id long, kind string, at long"))
    out = jobs.run_available(jobs.expiry(_replay(spark, df, tmp_path), 1_000, "10 seconds"), str(tmp_path))
    assert {(r.item_id, r.expired_at) for r in out.collect()} == {(1, 1_100), (3, 10_000)}


def test_a_renewed_item_expires_once_and_late(spark, tmp_path):
    rows = [(1, "created", 100), (1, "created", 900), (2, "created", 100), (2, "created", 200), (2, "responded", 1_150), (3, "created", 100), (3, "responded", 1_100), (4, "created", 50_000)]
    df = _with_ts(spark.createDataFrame(rows, "item_id long, kind string, at long"))
    out = jobs.run_available(jobs.expiry(_replay(spark, df, tmp_path), 1_000, "10 seconds"), str(tmp_path))
    assert sorted((r.item_id, r.created_at, r.expired_at) for r in out.collect()) == [(1, 900, 1_900), (3, 100, 1_100)]


def test_dedup_and_order(spark, tmp_path):
    rows = [("u", "e1", 10, 2), ("u", "e1", 10, 1), ("u", "e1", 10, 3), ("u", "e2", 5, 3), ("u", "e3", 11, 4), ("v", "e4", 1, 5)]
    df = spark.createDataFrame(rows, "user_key string, event_id string, occurred_at long, received_at long").withColumn("at", F.col("received_at") + 1000)
    out = jobs.run_available(jobs.event_dedup(_replay(spark, _with_ts(df), tmp_path, 2)), str(tmp_path))
    assert sorted((r.event_id, r.received_at) for r in out.collect()) == [("e1", 1), ("e3", 4), ("e4", 5)]


def test_keys_of_a_bucket_share_its_state(spark, tmp_path, monkeypatch):
    """One group for all keys: each keeps its own rows between triggers, and one without a key counts too."""
    monkeypatch.setattr(jobs, "BUCKETS", 1)
    rows = [(i, "created", 100 + i) for i in range(50)] + [(i, "responded", 700 + i) for i in range(0, 50, 2)] + [(None, "created", 120), (99, "created", 30_000)]
    items = _with_ts(spark.createDataFrame(rows, "item_id long, kind string, at long"))
    out = jobs.run_available(jobs.expiry(_replay(spark, items, tmp_path), 1_000, "10 seconds"), str(tmp_path)).collect()
    assert {(r.item_id, r.created_at) for r in out} == {(i, 100 + i) for i in range(1, 50, 2)} | {(None, 120)} and len(out) == 26


def test_many_events_share_few_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 2)
    rows = [(f"u{i % 7}", f"e{i // 2}", i // 3 * 10 % 401, 1_000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "user_key string, event_id string, occurred_at long, received_at long").withColumn("at", F.col("received_at"))
    out = jobs.run_available(jobs.event_dedup(_replay(spark, _with_ts(df), tmp_path, 2)), str(tmp_path))
    first, newest, want = set(), {}, []
    for user, event, occurred, received in rows:
        if event not in first and occurred > newest.get(user, -1):
            newest[user] = occurred
            want.append((event, received))
        first.add(event)
    assert sorted((r.event_id, r.received_at) for r in out.collect()) == sorted(want)
