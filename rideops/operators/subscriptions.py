"""Subscription state from the payment provider's event log.

Payloads are nested JSON, read as VARIANT. An event names its user in one of several ways, and
some of them are only known because an earlier event of the log taught them: a subscription or
customer id belongs to a user from the event that stored it until another one replaces it. These
spans and the events' users depend on each other, so both are computed in rounds until nothing
changes. An id serves events received in a later second, so each round settles at least the next
event of every chain and the fixed point is unique; usual logs need two or three rounds. A round
looks again only at ids whose spans the one before changed and at users whose events it changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideops.operators.ordered import with_previous, with_running
from rideops.operators.spans import FOREVER, least_holder
from rideops.session import cut_lineage
from rideops.sources.store import scratch_path

# Provider status to ours, and the status an event type sets by itself.
STATUS_MAP = {"active": "active", "trialing": "trialing", "past_due": "past_due", "paused": "paused",
              "canceled": "cancelled", "cancelled": "cancelled"}
TYPE_STATUS = {"subscription.trialing": "trialing", "subscription.activated": "active", "subscription.resumed": "active",
               "subscription.canceled": "cancelled", "subscription.past_due": "past_due", "transaction.payment_failed": "past_due"}
PAYLOAD_STATUS = ("subscription.created", "subscription.updated")
TRANSACTION, FAILED = "transaction.completed", "transaction.payment_failed"
HANDLED = (*TYPE_STATUS, *PAYLOAD_STATUS, TRANSACTION)
# Where a payload may hold an e-mail address, first to last.
EMAIL_PATHS = ("$.data.customer.email", "$.data.email", "$.data.customer_email", "$.data.user_email", "$.email")
DAY = 86400
REFS = {"subscription_id": "subscription_ref", "customer_id": "customer_ref"}
#: What the rounds carry of an event.
CARRIED = ("event_id", "event_type", "occurred_at", "received_at", "subscription_id", "customer_id", "status", "period_end")
#: Changed users or ids that are broadcast, and rounds between which events are written anew.
FEW, WRITE_EVERY = 2_000_000, 8


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet below the shared folder: compressed, and read by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Checkpointed and counted; hinted for broadcast if it has ``FEW`` rows at most."""
    df = cut_lineage(df)
    n = df.count()
    return (F.broadcast(df) if n <= FEW else df), n


def first_deliveries(events: DataFrame) -> DataFrame:
    """The first received row of each event id.

    Rows are long and an id seldom comes twice, so they are dealt by id first: combining before the
    shuffle would sort all of them by id and leave as many.
    """
    rest = [c for c in events.columns if c != "event_id"]
    order = ["received_at", "raw_event_json"]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("e")
    return events.repartition("event_id").groupBy("event_id").agg(first).select("event_id", *[F.col(f"e.{c}") for c in rest])


def _text(path: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get("_v", path, "string")), F.lit(""))


def _filled(path: str) -> Column:
    """Whether there is anything but null, an empty text or an empty object at ``path``."""
    return ~F.coalesce(F.try_variant_get("_v", path, "string"), F.lit("")).isin("", "{}", "[]", "0", "false")


def _first_of(*paths: str) -> Column:
    return F.coalesce(*map(_text, paths))


def _epoch(text: Column) -> Column:
    """Seconds of an ISO 8601 time; without an offset it is UTC, and what is no time is null."""
    return F.unix_timestamp(F.try_to_timestamp(text))


def _map(value: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def parsed_events(events: DataFrame) -> DataFrame:
    """What the payloads say: who is meant, which ids to store, status and period end.

    Rows whose payload is no JSON are left out. ``own_id`` is a whole number in custom_data of the
    data or else of the event; what is no number does not count. A subscription.* event is about
    the subscription ``data.id``. Ids to look up and ids to store differ: a customer object serves
    look-ups alone.
    """
    e = events.withColumn("_v", F.try_parse_json("raw_event_json")).where(F.col("_v").isNotNull())
    custom = F.when(_filled("$.data.custom_data"), F.lit("$.data.custom_data")).otherwise(F.lit("$.custom_data"))
    e = e.withColumn("_own", F.when(custom == "$.data.custom_data", F.try_variant_get("_v", "$.data.custom_data.user_id", "variant"))
                     .otherwise(F.try_variant_get("_v", "$.custom_data.user_id", "variant")))
    own_text = F.trim(F.try_variant_get("_own", "$", "string"))
    fraction = F.schema_of_variant("_own").rlike("^(DECIMAL|DOUBLE|FLOAT)")
    own = F.when(fraction, F.try_variant_get("_own", "$", "double").cast("long")).when(own_text.rlike("^[+-]?[0-9]+$"), own_text.try_cast("long"))
    about = F.lower("event_type").startswith("subscription.")
    period = F.when(_filled("$.data.current_billing_period"), _text("$.data.current_billing_period.ends_at")).otherwise(_text("$.data.billing_period.ends_at"))
    is_set = F.col("event_type").startswith("subscription.")
    return e.select(
        "event_id", "event_type", "occurred_at", "received_at", own.alias("own_id"),
        F.coalesce(_text("$.data.subscription_id"), F.when(about, _text("$.data.id"))).alias("subscription_ref"),
        _first_of("$.data.customer_id", "$.data.customer.id").alias("customer_ref"),
        F.array_compact(F.array(*[F.lower(_text(p)) for p in EMAIL_PATHS])).alias("emails"),
        F.when(is_set, _first_of("$.data.id", "$.data.subscription_id")).otherwise(_text("$.data.subscription_id")).alias("subscription_id"),
        _text("$.data.customer_id").alias("customer_id"),
        _map(F.lower(_text("$.data.status")), STATUS_MAP).alias("status"),
        _epoch(F.coalesce(period, _text("$.data.next_billed_at"))).alias("period_end"))


def applied_events(resolved: DataFrame, users: DataFrame) -> DataFrame:
    """Events that take effect, in arrival order: newer than the stored time and every one applied before.

    A skipped event never raises the maximum, so "newer than all applied" is "newer than all
    before", a running maximum. A completed transaction without period and ids does not count.
    """
    e = resolved.filter(F.col("event_type").isin(*HANDLED))
    counts = (F.col("event_type") != TRANSACTION) | F.col("period_end").isNotNull() | F.col("customer_id").isNotNull() | F.col("subscription_id").isNotNull()
    e = with_running(e, "user_id", "received_at", ["received_at", "event_id"], {"newest": ("max", F.when(counts, F.col("occurred_at")))}, DAY, strict=True)
    e = e.join(users.select("user_id", F.col("subscription_updated_at").alias("_stored")), "user_id")
    newest = F.greatest("newest", "_stored")
    return e.filter(newest.isNull() | (F.col("occurred_at") > newest)).withColumn("counts", counts).drop("newest", "_stored")


def id_spans(applied: DataFrame, users: DataFrame, name: str) -> DataFrame:
    """(key, holder, since, until): who holds which id of kind ``name`` at what time.

    A subscription event replaces the stored id, a transaction fills it in where there is none.
    The last change of a second counts.
    """
    order = F.struct("received_at", "event_id")
    rows = applied.filter(F.col(name).isNotNull() & F.col("event_type").isin(*[t for t in HANDLED if t != FAILED]))
    sets = rows.filter(F.col("event_type") != TRANSACTION).select("user_id", F.col("received_at").alias("at"), order.alias("_o"), F.col(name).alias("key"))
    fills = rows.filter(F.col("event_type") == TRANSACTION).groupBy("user_id").agg(
        F.min("received_at").alias("at"), F.min(order).alias("_o"), F.min_by(name, order).alias("key"))
    first = sets.groupBy("user_id").agg(F.min("_o").alias("_first"))
    empty = users.filter(F.col(name).isNull()).select("user_id")
    fills = fills.join(empty, "user_id", "left_semi").join(first, "user_id", "left").filter(F.col("_first").isNull() | (F.col("_o") < F.col("_first"))).drop("_first")
    stored = users.filter(F.col(name).isNotNull()).select("user_id", F.lit(-1).cast("long").alias("at"), F.lit(None).alias("_o"), F.col(name).alias("key"))
    changes = sets.unionByName(fills).groupBy("user_id", "at").agg(F.max_by("key", "_o").alias("key")).unionByName(stored.drop("_o"))
    changes = with_previous(cut_lineage(changes), "user_id", "at", "at", ["key"], DAY)
    changes = cut_lineage(changes.filter(~F.col("key").eqNullSafe(F.col("prev_key"))).withColumn("_back", -F.col("at")))
    spans = with_previous(changes, "user_id", "_back", "_back", ["at"], DAY)
    return spans.select("key", F.col("user_id").alias("holder"), F.col("at").alias("since"), F.coalesce("prev_at", F.lit(FOREVER)).alias("until"))


def _settled(parsed: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events with a known own id, the other events with their user or null, events that take effect), all narrow.

    A round looks up the ids whose spans changed, finds the users whose events this changes, and
    computes their applied events and spans again; where these are most users, all are.
    """
    known = users.select("user_id").distinct()
    population = known.count()
    owned = _written(parsed.filter(F.col("own_id").isNotNull()).withColumn("user_id", F.col("own_id")).join(known, "user_id", "left_semi").select("user_id", *CARRIED), "owned")
    rest = parsed.filter(F.col("own_id").isNull())
    address = users.select("user_id", F.lower(F.trim("email")).alias("email")).filter(F.col("email") != "").groupBy("email").agg(F.min("user_id").alias("user_id"))
    by_mail = rest.select("event_id", F.posexplode("emails").alias("_p", "email")).join(address, "email").groupBy("event_id").agg(
        F.min_by("user_id", "_p").alias("u_email"))
    nobody = F.lit(None).cast(users.schema["user_id"].dataType)
    links = _written(rest.select(*CARRIED, *REFS.values()).join(by_mail, "event_id", "left").withColumns(
        {"user_id": nobody, **{f"u_{name}": nobody for name in REFS}}), "links")
    applied = _written(applied_events(owned, users), "applied")
    spans = {name: cut_lineage(id_spans(applied, users, name)) for name in REFS}
    stale: dict[str, DataFrame | None] = dict.fromkeys(REFS)  # ids to look up; None: all

    def renewed(links: DataFrame, name: str) -> DataFrame:
        """``links`` with the holders of the stale ids of kind ``name``."""
        asked, held = links.filter(F.col(REFS[name]).isNotNull()).withColumn("key", F.col(REFS[name])), spans[name]
        if stale[name] is not None:
            asked, held = (cut_lineage(df.join(stale[name], "key", "left_semi")) for df in (asked.select("event_id", "key", "received_at"), held))
        found = least_holder(asked.select(F.col("event_id").alias("point_id"), "key", F.col("received_at").alias("at")), held)
        found = found.select(F.col("point_id").alias("event_id"), F.col("holder").alias("_holder"))
        if stale[name] is None:
            return links.drop(f"u_{name}").join(found, "event_id", "left").withColumnRenamed("_holder", f"u_{name}")
        again, _ = _counted(asked.select("event_id", F.lit(True).alias("_again")).join(found, "event_id", "left"))
        holder = F.when(F.col("_again"), F.col("_holder")).otherwise(F.col(f"u_{name}"))
        return links.join(again, "event_id", "left").withColumn(f"u_{name}", holder).drop("_again", "_holder")

    turn = 0
    while True:
        turn += 1
        links = links.withColumnRenamed("user_id", "_before")
        for name in REFS:
            links = renewed(links, name)
        links = links.withColumn("user_id", F.coalesce("u_subscription_id", "u_customer_id", "u_email"))
        write = stale["subscription_id"] is None or turn % WRITE_EVERY == 0
        links = _written(links, "links") if write else links
        moved = links.filter(~F.col("user_id").eqNullSafe(F.col("_before"))).select(F.explode(F.array("_before", "user_id")).alias("user_id"))
        touched, n = _counted(moved.filter(F.col("user_id").isNotNull()).distinct())
        links = links.drop("_before")
        if n == 0:
            return owned, links, applied
        resolved = owned.unionByName(links.filter(F.col("user_id").isNotNull()).select("user_id", *CARRIED))
        if n * 2 > population:
            applied = _written(applied_events(resolved, users), "applied")
            spans = {name: cut_lineage(id_spans(applied, users, name)) for name in REFS}
            stale = dict.fromkeys(REFS)
            continue
        theirs = users.join(touched, "user_id", "left_semi")
        new = _written(applied_events(resolved.join(touched, "user_id", "left_semi"), theirs), "applied")
        applied = applied.join(touched, "user_id", "left_anti").unionByName(new)
        holders = touched.withColumnRenamed("user_id", "holder")
        for name in REFS:
            old, now = spans[name].join(holders, "holder", "left_semi"), cut_lineage(id_spans(new, theirs, name))
            differ = old.withColumn("_n", F.lit(-1)).unionByName(now.withColumn("_n", F.lit(1))).groupBy("key", "holder", "since", "until").agg(F.sum("_n").alias("_n")).filter("_n != 0")
            stale[name] = _counted(differ.select("key").distinct())[0]
            spans[name] = spans[name].join(holders, "holder", "left_anti").unionByName(now)
        if turn % WRITE_EVERY == 0:
            applied, spans = _written(applied, "applied"), {name: cut_lineage(held) for name, held in spans.items()}


def resolve_users(parsed: DataFrame, users: DataFrame) -> DataFrame:
    """Events with their user: by own id, else subscription id, customer id, first known e-mail.

    An own id ends the search even if no such user exists. Of several holders of an id the
    smallest user counts. Events without a known user are dropped.
    """
    known = users.select("user_id").distinct()
    owned = parsed.filter(F.col("own_id").isNotNull()).withColumn("user_id", F.col("own_id")).join(known, "user_id", "left_semi")
    links = _settled(parsed, users)[1].filter(F.col("user_id").isNotNull()).select("event_id", "user_id")
    return owned.unionByName(parsed.filter(F.col("own_id").isNull()).join(links, "event_id"))


def subscription_state(events: DataFrame, users: DataFrame) -> DataFrame:
    """Subscription fields per user after the whole log, for users with an applied event.

    ``users`` brings the stored fields: subscription_id, customer_id, subscription_status,
    subscription_current_period_end and subscription_updated_at. Every field is the value of the
    last event that sets it, so the fold is one aggregation that combines before the shuffle.
    """
    parsed = _written(parsed_events(first_deliveries(events)), "parsed")
    a = _settled(parsed, users)[2]
    kind, order = F.col("event_type"), F.struct("received_at", "event_id")
    is_transaction = kind == TRANSACTION
    status = (F.when(kind.isin(*PAYLOAD_STATUS), F.col("status"))
              .when(is_transaction, F.when(F.col("period_end").isNotNull(), "active")).otherwise(_map(kind, TYPE_STATUS)))
    period = F.when(kind != FAILED, F.col("period_end"))

    def last(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), order))

    def own_id(name: str) -> tuple[Column, Column]:
        sets = F.when(kind.startswith("subscription."), F.col(name))
        fills = F.when(is_transaction, F.col(name))
        return last(sets), F.min_by(fills, F.when(fills.isNotNull(), order))

    sub, sub_fill = own_id("subscription_id")
    cus, cus_fill = own_id("customer_id")
    folded = a.withColumns({"_status": status, "_period": period}).groupBy("user_id").agg(
        F.count("*").alias("applied_events"), last(F.col("_status")).alias("status"), F.max((kind == "subscription.created").cast("int")).alias("created"),
        last(F.col("_period")).alias("period_end"), F.max(F.when(F.col("counts"), F.col("occurred_at"))).alias("updated_at"),
        sub.alias("sub"), sub_fill.alias("sub_fill"), cus.alias("cus"), cus_fill.alias("cus_fill"))
    stored = users.select("user_id", F.col("subscription_status").alias("old_status"), F.col("subscription_id").alias("old_sub"), F.col("customer_id").alias("old_cus"),
                          F.col("subscription_current_period_end").alias("old_period"), F.col("subscription_updated_at").alias("old_updated"))
    return folded.join(stored, "user_id").select(
        "user_id", "applied_events", F.coalesce("status", "old_status", F.when(F.col("created") == 1, "trialing")).alias("subscription_status"),
        F.coalesce("sub", "old_sub", "sub_fill").alias("subscription_id"), F.coalesce("cus", "old_cus", "cus_fill").alias("customer_id"),
        F.coalesce("period_end", "old_period").alias("current_period_end"), F.coalesce("updated_at", "old_updated").alias("updated_at"))
