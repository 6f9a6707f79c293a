"""Structured Streaming versions of the stateful operators, in event time.

Input streams carry a timestamp column ``ts`` next to the epoch column of their batch
counterpart. Jobs whose result depends on order keep rows in state until the watermark has passed
them and take them in time order, so the result does not depend on how rows fell into triggers:
it is the batch result of the rows before the watermark. ``maxBytesPerTrigger`` of the source
bounds a trigger. The stateful jobs need the RocksDB state store (:func:`require_state_store`).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from rideops.operators import drivers
from rideops.operators.drivers import MAX_COUNTED_GAP, MAX_MPH, MIN_MILES, MIN_MPH
from rideops.operators.guidance import GUARD_SCHEMA, SESSION_BREAK, AcceptedTrips, GuardState, guard_step
from rideops.operators.outcomes import HOTSPOT_MAX_MILES, WINDOW_SECONDS, OpenRecs, miles_between
from rideops.streaming.totals import append_totals, read_totals

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STALE_SECONDS = 300
#: Rows of one frame of output or state.
FRAME_ROWS = 10_000
#: Groups the keys of a stream are dealt into. A checkpoint holds for one number only.
BUCKETS = 1024
_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def require_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _fields(schema: str) -> dict[str, pa.DataType]:
    return {name: _TYPES[kind] for name, kind in (part.split() for part in schema.split(", "))}


def _names(schema: str) -> list[str]:
    return list(_fields(schema))


def _packed(rows: list[tuple], schema: str) -> bytes:
    """Rows as one Arrow table."""
    fields = _fields(schema)
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return _sent(pa.table({n: pa.array(c, t) for (n, t), c in zip(fields.items(), columns)}))


def _sent(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _frame(batch: pd.DataFrame, schema: str) -> pa.Table:
    """Columns of a batch, NaN as null."""
    return pa.Table.from_pandas(batch[_names(schema)], pa.schema(list(_fields(schema).items())), preserve_index=False)


def _rows(table: pa.Table) -> list[tuple]:
    """Rows as plain Python values, null as None."""
    return list(zip(*(c.to_pylist() for c in table.columns)))


class BucketProcessor(StatefulProcessor):
    """State of all keys of one bucket, as Arrow tables in lists.

    A group for each driver or event costs several calls between Python and the state store, up to
    tens of milliseconds each; a bucket takes the rows of its keys at once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open_state(handle)

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


def read_rows(state: ListState) -> list[tuple]:
    return [row for (frame,) in state.get() for row in _rows(pa.ipc.open_stream(frame).read_all())]


def keep(state: ListState, rows: list[tuple], schema: str) -> None:
    """A list of frames in state becomes ``rows``."""
    if rows:
        state.put([(_packed(rows[i:i + FRAME_ROWS], schema),) for i in range(0, len(rows), FRAME_ROWS)])
    else:
        state.clear()


def in_buckets(stream: DataFrame, keys: list[str]) -> GroupedData:
    return stream.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).groupBy("_bucket")


class OrderedProcessor(BucketProcessor):
    """Takes the rows of a key in time order, each once the watermark has passed it.

    ``KEY`` is the schema of a key, ``ROW`` that of the waiting rows, ``at`` first and then what
    breaks ties, ``KEPT`` that of the rows a key keeps between its turns, ``OUT`` that of the output.
    :meth:`take` gets what a key has kept and its due rows, sorted, gives output rows and leaves in
    ``kept`` what is to stay; :meth:`due` says up to which second a key that keeps such rows waits
    for the watermark, if it does. Output leaves in frames of bounded size; memory holds the rows of
    one bucket's keys within the watermark's delay.
    """

    KEY = ROW = KEPT = OUT = ""

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "frame binary")
        self.kept = handle.getListState("kept", "frame binary")

    def take(self, key: tuple, kept: list[tuple], rows: list[tuple], now: float) -> Iterable[tuple]:
        """Output for the due ``rows``, in order, and for the passage of time up to ``now`` (seconds)."""
        raise NotImplementedError

    def due(self, kept: list[tuple]) -> int | None:
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [_frame(batch, f"{self.KEY}, {self.ROW}") for batch in rows]
        self.waiting.appendList([(_sent(f),) for f in frames])
        self.handle.registerTimer(min(pc.min(f["at"]).as_py() for f in frames) * 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, width = timerValues.getCurrentWatermarkInMs() / 1000, len(_names(self.KEY))
        later, due, kept = [], defaultdict(list), defaultdict(list)
        for row in read_rows(self.waiting):
            if row[width] < now:
                due[row[:width]].append(row[width:])
            else:
                later.append(row)
        for row in read_rows(self.kept):
            kept[row[:width]].append(row[width:])

        def waits(rows: list[tuple]) -> int | None:
            return self.due(rows) if rows else None

        turns = [*due, *(k for k, rows in kept.items() if k not in due and (at := waits(rows)) is not None and at < now)]
        if not turns:
            return  # an earlier timer of this trigger took all
        out = (row for k in turns for row in self.take(k, kept[k], sorted(due[k]), now))
        while frame := list(islice(out, FRAME_ROWS)):
            yield pd.DataFrame(frame, columns=_names(self.OUT))
        keep(self.waiting, later, f"{self.KEY}, {self.ROW}")
        keep(self.kept, [(*k, *row) for k, rows in kept.items() for row in rows], f"{self.KEY}, {self.KEPT}")
        times = [row[width] for row in later] + [at for rows in kept.values() if (at := waits(rows)) is not None]
        if times:
            self.handle.registerTimer(min(times) * 1000 + 1)


def ordered(stream: DataFrame, processor: OrderedProcessor, delay: str) -> DataFrame:
    keys = _names(processor.KEY)
    narrow = stream.select(*keys, *_names(processor.ROW), "ts").withWatermark("ts", delay)
    return in_buckets(narrow, keys).transformWithStateInPandas(processor, outputStructType=processor.OUT, outputMode="Append", timeMode="EventTime")


def zone_demand(points: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Pickups per zone in 20-minute windows, emitted once the watermark passes them."""
    counts = points.withWatermark("ts", delay).groupBy(F.window("ts", "20 minutes"), "zone_id").agg(F.count("*").alias("pickups"))
    return counts.select(F.unix_timestamp("window.start").alias("bin_epoch"), "zone_id", "pickups")


def sessions(heartbeats: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Driver sessions that break at more than 480 s of silence.

    Session windows that only touch are merged, so a gap of exactly 480 s does not break.
    """
    window = F.session_window("ts", f"{SESSION_BREAK} seconds")
    out = heartbeats.withWatermark("ts", delay).groupBy("user_id", window).agg(
        F.count("*").alias("heartbeats"), F.min("at").alias("started_at"), F.max("at").alias("ended_at"))
    return out.select("user_id", "started_at", "ended_at", "heartbeats")


class PresenceProcessor(OrderedProcessor):
    """Every position of a driver, and a removal when nothing follows for 300 s."""

    KEY = "user_id long"
    ROW = "at long, event_id long, lat double, lng double"
    KEPT = "at long, lat double, lng double"
    OUT = "user_id long, kind string, at long, lat double, lng double"

    def take(self, key: tuple, kept: list[tuple], rows: list[tuple], now: float) -> Iterable[tuple]:
        last = kept[0] if kept else None
        for at, _, lat, lng in rows:
            if last is not None and at - last[0] > STALE_SECONDS:
                yield (*key, "stale", *last)
            last = (at, lat, lng)
            yield (*key, "item", *last)
        if last is not None and now - last[0] > STALE_SECONDS:
            yield (*key, "stale", *last)
            last = None
        kept[:] = [] if last is None else [last]

    def due(self, kept: list[tuple]) -> int | None:
        return kept[0][0] + STALE_SECONDS


def presence(heartbeats: DataFrame, delay: str = "1 minute") -> DataFrame:
    return ordered(heartbeats, PresenceProcessor(), delay)


class SegmentProcessor(OrderedProcessor):
    """Counted interval from the previous heartbeat."""

    KEY = "user_id long"
    ROW = "at long, event_id long, lat double, lng double"
    KEPT = "at long, lat double, lng double"
    OUT = "user_id long, event_id long, at long, counted_seconds long, counted_miles double"

    def take(self, key: tuple, kept: list[tuple], rows: list[tuple], now: float) -> Iterable[tuple]:
        last = kept[0] if kept else None
        for at, event_id, lat, lng in rows:
            seconds, miles = 0, 0.0
            gap = at - last[0] if last else 0
            if gap > 0:
                d = miles_between(last[1], last[2], lat, lng)
                if MIN_MPH <= d / (gap / 3600.0) <= MAX_MPH and d >= MIN_MILES:
                    seconds, miles = min(gap, MAX_COUNTED_GAP), d
            last = (at, lat, lng)
            yield (*key, event_id, at, seconds, miles)
        kept[:] = [] if last is None else [last]


def daily_segments(heartbeats: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Per heartbeat what it adds; feed to :func:`append_daily_stats` in ``foreachBatch``."""
    return ordered(heartbeats, SegmentProcessor(), delay)


def append_daily_stats(path: str, compact_every: int = 50) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer of the trigger's totals per driver and date; see :mod:`rideops.streaming.totals`."""
    def totals(batch: DataFrame) -> DataFrame:
        rows = drivers.split_by_business_day(batch).select("user_id", "nyc_date", F.col("split_miles").alias("miles"), F.col("seconds").cast("long").alias("seconds"), F.lit(0).cast("long").alias("beats"))
        return rows.unionByName(batch.select("user_id", drivers.times.business_date(F.col("at")).alias("nyc_date"), F.lit(0.0).alias("miles"), F.lit(0).cast("long").alias("seconds"),
                                             F.lit(1).cast("long").alias("beats")))

    return append_totals(path, totals, ["user_id"], "nyc_date", ["miles", "seconds", "beats"], compact_every)


def read_daily_stats(spark: SparkSession, path: str) -> DataFrame:
    return read_totals(spark, path, ["user_id"], "nyc_date", ["miles", "seconds", "beats"]).select(
        "user_id", "nyc_date", F.col("miles").alias("miles_worked"), (F.col("seconds") / 3600.0).alias("hours_worked"), F.col("beats").alias("heartbeat_count"))


class GuardProcessor(OrderedProcessor):
    """The pickup guard's fold with its state kept between triggers.

    A driver keeps the last heartbeat, the last session's end, the streak (its two times as ``at``
    and ``event_id``) and the accepted pickups, all of them, since a void brings back the one before it.
    """

    KEY = "user_id long"
    ROW = "at long, kind int, event_id long, lat double, lng double"
    KEPT = "what string, at long, event_id long, lat double, lng double"
    OUT = GUARD_SCHEMA
    PLACES = ("last", "session_end")

    def take(self, key: tuple, kept: list[tuple], rows: list[tuple], now: float) -> Iterable[tuple]:
        guard = GuardState()
        for what, at, event_id, lat, lng in kept:
            if what in self.PLACES:
                setattr(guard, what, (at, lat, lng))
            elif what == "streak":
                guard.streak = (at, event_id)
        guard.accepted = AcceptedTrips([(*row, None) for what, *row in kept if what == "accepted"])
        for row in rows:
            yield from guard_step(guard, (*key, *row))
        places = [(f, at, None, lat, lng) for f in self.PLACES if (p := getattr(guard, f)) for at, lat, lng in [p]]
        kept[:] = [*places, ("streak", *guard.streak, None, None), *(("accepted", *row[:4]) for row in guard.accepted.rows)]


def pickup_guard(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Guard states and decisions over united heartbeats (kind 0), attempts (kind 1) and their voids (kind 2)."""
    return ordered(events, GuardProcessor(), delay)


DELIVERY = "user_key string, event_id string, occurred_at long, received_at long"


def prefix_maxima(rows: Iterable[tuple], newest: dict) -> list[tuple]:
    """Of deliveries in order of arrival, those newer than the key's newest so far, which is kept up to date."""
    out = []
    for row in sorted(rows, key=lambda r: (r[3], r[1])):
        if newest.get(row[0]) is None or row[2] > newest[row[0]]:
            newest[row[0]] = row[2]
            out.append(row)
    return out


class FirstProcessor(BucketProcessor):
    """The copy of an event that was received first; later ones go while it is remembered.

    What cannot be newest among the trigger's own events goes at once, so a key with many events
    sends few rows on.
    """

    SEEN = "event_id string, until long"

    def __init__(self, remember_seconds: int) -> None:
        self.remember = remember_seconds

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "frame binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, first = {event for event, _ in read_rows(self.seen)}, {}
        for batch in rows:
            for row in _rows(_frame(batch, DELIVERY)):
                known = first.get(row[1])
                if row[1] not in seen and (known is None or _arrival(row) < _arrival(known)):
                    first[row[1]] = row
        if first:
            until = [(row[1], row[3] + self.remember) for row in first.values()]
            self.seen.appendList([(_packed(until, self.SEEN),)])
            self.handle.registerTimer(min(at for _, at in until) * 1000)
            yield pd.DataFrame(prefix_maxima(first.values(), {}), columns=_names(DELIVERY))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = [row for row in read_rows(self.seen) if row[1] * 1000 > timerValues.getCurrentWatermarkInMs()]
        keep(self.seen, left, self.SEEN)
        if left:
            self.handle.registerTimer(min(at for _, at in left) * 1000)
        return iter(())


def _arrival(row: tuple) -> tuple:
    return row[3], row[2], row[0]


class NewestProcessor(BucketProcessor):
    """Drops events that are not newer than the newest one let through before, in order of arrival."""

    NEWEST = "user_key string, occurred_at long"

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getListState("newest", "frame binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = dict(read_rows(self.newest))
        out = prefix_maxima([row for batch in rows for row in _rows(_frame(batch, DELIVERY))], newest)
        keep(self.newest, list(newest.items()), self.NEWEST)
        yield pd.DataFrame(out, columns=_names(DELIVERY))


def event_dedup(events: DataFrame, delay_seconds: int = 86400) -> DataFrame:
    """First delivery of each event id, then only events newer than the key's newest one.

    Of several copies the one received first survives. An id is remembered for the watermark's
    delay, which bounds the state.
    """
    rows = events.select(*_names(DELIVERY), "ts").withWatermark("ts", f"{delay_seconds} seconds")
    fresh = in_buckets(rows, ["event_id"]).transformWithStateInPandas(FirstProcessor(delay_seconds), outputStructType=DELIVERY, outputMode="Append", timeMode="EventTime")
    return in_buckets(fresh, ["user_key"]).transformWithStateInPandas(NewestProcessor(), outputStructType=DELIVERY, outputMode="Append", timeMode="None")


class ExpiryProcessor(OrderedProcessor):
    """Pending items that get no response within the time to live. Creating one again renews it."""

    KEY = "item_id long"
    ROW = "at long, kind string"
    KEPT = "at long"
    OUT = "item_id long, created_at long, expired_at long"

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds

    def take(self, key: tuple, kept: list[tuple], rows: list[tuple], now: float) -> Iterable[tuple]:
        pending = kept[0][0] if kept else None
        for at, kind in [*rows, (now, "")]:
            if pending is not None and (at > pending + self.ttl if kind == "" else at >= pending + self.ttl):
                yield (*key, pending, pending + self.ttl)
                pending = None
            if kind:
                pending = at if kind == "created" else None
        kept[:] = [] if pending is None else [(pending,)]

    def due(self, kept: list[tuple]) -> int | None:
        return kept[0][0] + self.ttl


def expiry(items: DataFrame, ttl_seconds: int = 86400, delay: str = "10 minutes") -> DataFrame:
    """Expired items of a stream of (item_id, kind created|responded, at, ts)."""
    return ordered(items, ExpiryProcessor(ttl_seconds), delay)


SETTLED = ("user_id long, zone_id int, recommendation_id long, recommended_at long, pickup_id long, picked_up_at long, "
           "minutes_to_trip double, distance_miles double, converted_to_trip boolean")


class SettlementProcessor(OrderedProcessor):
    """One-to-one claims of one user and zone.

    Open recommendations are kept: a pickup claims one as in the batch operator, and one that
    outlives its window comes out unconverted.
    """

    KEY = "user_id long, zone_id int"
    ROW = "at long, kind int, event_id long, lat double, lng double"
    KEPT = "at long, event_id long, lat double, lng double"
    OUT = SETTLED

    def __init__(self, max_miles: float, fallback: bool) -> None:
        self.max_miles, self.fallback = max_miles, fallback

    def take(self, key: tuple, kept: list[tuple], rows: list[tuple], now: float) -> Iterable[tuple]:
        held = OpenRecs(kept)
        for at, kind, event_id, lat, lng in [*rows, (now, None, None, None, None)]:
            for rec in held.expire(at):
                yield (*key, rec[1], rec[0], None, None, None, None, False)
            if kind == 0:
                held.append((at, event_id, lat, lng))
            found = held.claim(at, lat, lng, self.max_miles, self.fallback) if kind == 1 else None
            if found:
                rec, miles = found
                yield (*key, rec[1], rec[0], event_id, at, (at - rec[0]) / 60.0, miles, True)
        kept[:] = held

    def due(self, kept: list[tuple]) -> int | None:
        return kept[0][0] + WINDOW_SECONDS


def settlement_events(recommendations: DataFrame, pickups: DataFrame) -> DataFrame:
    """Both inputs of :func:`outcome_settlement` as one stream; kind 0 recommends, 1 picks up."""
    rec = recommendations.select("user_id", "zone_id", "ts", F.col("recommended_at").alias("at"), F.lit(0).alias("kind"), F.col("recommendation_id").alias("event_id"),
                                 F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"))
    return rec.unionByName(pickups.select("user_id", "zone_id", "ts", F.col("created_at").alias("at"), F.lit(1).alias("kind"), F.col("pickup_id").alias("event_id"), "lat", "lng"))


def outcome_settlement(events: DataFrame, max_miles: float = HOTSPOT_MAX_MILES, fallback: bool = True, delay: str = "10 minutes") -> DataFrame:
    """Settled recommendations of a stream of :func:`settlement_events`, each once.

    What comes out is what :func:`rideops.operators.outcomes.settle_outcomes` gives, for pickups
    before the watermark, and the recommendations whose window of 5400 s lies before it unclaimed.
    """
    return ordered(events, SettlementProcessor(max_miles, fallback), delay)


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Process everything available into parquet below ``path`` and read it back."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
