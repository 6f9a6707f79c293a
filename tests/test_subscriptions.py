"""Subscription events: every way to the user, stored times, and random logs against a plain walk."""

from __future__ import annotations

import json
import random
from datetime import datetime, timezone

import pytest

from rideops.operators import subscriptions as s
from rideops.operators.spans import FOREVER, least_holder

EVENTS = "event_id string, event_type string, occurred_at long, received_at long, raw_event_json string"
USERS = ("user_id long, email string, subscription_id string, customer_id string, subscription_status string, "
         "subscription_current_period_end long, subscription_updated_at long")


def _state(spark, users, events):
    rows = [(f"e{i}", kind, at, 1000 + i, body if isinstance(body, str) else json.dumps(body)) for i, (kind, at, body) in enumerate(events)]
    out = s.subscription_state(spark.createDataFrame(rows, EVENTS), spark.createDataFrame(users, USERS))
    return {r.user_id: r.asDict() for r in out.collect()}


def _user(i, sub=None, cus=None, mail=None, status=None, end=None, updated=None):
    return (i, mail or f"u{i}@x.org", sub, cus, status, end, updated)


PATHS = {
    "own id in the data, as text": {"data": {"custom_data": {"user_id": " 7 "}}},
    "own id in the data, as a number": {"data": {"custom_data": {"user_id": 7}}},
    "own id in the event when the data's is empty": {"custom_data": {"user_id": 7}, "data": {"custom_data": {}}},
    "data.subscription_id": {"data": {"subscription_id": "S7", "id": "S1"}},
    "data.id of a subscription": {"data": {"id": "S7"}},
    "data.customer_id": {"data": {"id": "unknown", "customer_id": "C7"}},
    "customer.id": {"data": {"customer": {"id": "C7"}}},
    "customer.email": {"data": {"customer": {"id": "unknown", "email": " U7@X.org"}}},
    "data.email": {"data": {"email": "u7@x.org", "customer_email": "u1@x.org"}},
    "data.customer_email after an unknown address": {"data": {"email": "nobody@x.org", "customer_email": "u7@x.org"}},
    "data.user_email": {"data": {"user_email": "u7@x.org"}},
    "event.email": {"email": "u7@x.org", "data": {"customer": "text"}},
    "own id that is no number": {"data": {"custom_data": {"user_id": "7.5"}, "subscription_id": "S7"}},
}


@pytest.fixture(scope="module")
def by_path(spark):
    rows = [(name, "subscription.updated", 50, 1000 + i, json.dumps(body)) for i, (name, body) in enumerate(PATHS.items())]
    users = spark.createDataFrame([_user(1, "S1", "C1"), _user(7, "S7", "C7"), _user(9, "S7")], USERS)
    resolved = s.resolve_users(s.parsed_events(spark.createDataFrame(rows, EVENTS)), users)
    return {r.event_id: r.user_id for r in resolved.collect()}


@pytest.mark.parametrize("name", PATHS)
def test_each_path_leads_to_the_user(by_path, name):
    assert by_path[name] == 7


def test_who_is_not_found(spark):
    bodies = [{"data": {"custom_data": {"user_id": 99}, "subscription_id": "S7"}}, {"data": {"id": "S8", "email": "x@y"}}, "no json", {"data": None}]
    assert _state(spark, [_user(7, "S7")], [("subscription.updated", 50, b) for b in bodies]) == {}


def test_ids_learned_from_earlier_events(spark):
    learn = {"data": {"custom_data": {"user_id": 5}, "id": "S5", "customer_id": "C5", "status": "trialing"}}
    log = [
        ("subscription.updated", 40, {"data": {"id": "S5", "status": "paused"}}),  # not known yet
        ("subscription.created", 50, learn),
        ("subscription.updated", 60, {"data": {"id": "S6", "customer_id": "C5", "status": "active"}}),  # by customer; teaches S6
        ("subscription.past_due", 70, {"data": {"id": "S6", "billing_period": {"ends_at": "1970-01-01T00:10:00+00:05"}}}),  # by what the last one taught
        ("subscription.canceled", 80, {"data": {"id": "S5"}}),  # replaced meanwhile
        ("transaction.completed", 90, {"data": {"subscription_id": "S6", "customer_id": "C9", "next_billed_at": "1970-01-01T00:20:00Z"}}),
    ]
    got = _state(spark, [_user(5), _user(6)], log)
    assert got == {5: {"user_id": 5, "applied_events": 4, "subscription_status": "active", "subscription_id": "S6", "customer_id": "C5",
                       "current_period_end": 1200, "updated_at": 90}}


def test_stored_time_and_period(spark):
    log = [("subscription.updated", at, {"data": {"id": "S1", "status": status}}) for at, status in ((99, "paused"), (100, "paused"), (101, "past_due"))]
    got = _state(spark, [_user(1, "S1", "C1", status="active", end=777, updated=100)], log)[1]
    assert (got["applied_events"], got["subscription_status"], got["current_period_end"], got["updated_at"]) == (1, "past_due", 777, 101)


def test_redelivery_failed_payment_and_bad_times(spark):
    body = json.dumps({"data": {"id": "S1", "status": "active", "current_billing_period": {"ends_at": "soon"}}})
    rows = [("e1", "subscription.updated", 10, 5, body), ("e1", "subscription.canceled", 99, 6, body), ("e2", "transaction.payment_failed", 20, 7, json.dumps({"data": {"subscription_id": "S1"}}))]
    out = s.subscription_state(spark.createDataFrame(rows, EVENTS), spark.createDataFrame([_user(1, "S1")], USERS)).collect()
    assert [(r.applied_events, r.subscription_status, r.current_period_end, r.updated_at) for r in out] == [(2, "past_due", None, 20)]


def _iso(seconds):
    return datetime.fromtimestamp(seconds, timezone.utc).isoformat()


def _walk(users, events):
    """One event after the other, as they are received."""
    state = {u[0]: dict(zip(("mail", "sub", "cus", "status", "end", "updated"), u[1:]), n=0) for u in users}
    for kind, at, body in events:
        data = body["data"]
        user = data.get("custom_data", {}).get("user_id")
        if user is None:
            ref = data.get("subscription_id") or (data.get("id") if kind.startswith("subscription.") else None)
            for field, value in (("sub", ref), ("cus", data.get("customer_id")), ("mail", data.get("email"))):
                holders = sorted(u for u, st in state.items() if value and st[field] == value)
                if user is None and holders:
                    user = holders[0]
        st = state.get(user)
        if st is None or (st["updated"] is not None and st["updated"] >= at):
            continue
        st["n"] += 1
        period = 60 * data["end"] if data.get("end") else None
        if kind == "transaction.completed":
            if period is not None:
                st["status"], st["end"] = "active", period
            if period is not None or data.get("customer_id") or data.get("subscription_id"):
                st["updated"] = at
            st["sub"], st["cus"] = st["sub"] or data.get("subscription_id"), st["cus"] or data.get("customer_id")
            continue
        st["sub"], st["cus"], st["end"], st["updated"] = data.get("id") or st["sub"], data.get("customer_id") or st["cus"], period or st["end"], at
        st["status"] = "cancelled" if kind.endswith("canceled") else data.get("status") or st["status"]
    return {u: (st["n"], st["status"], st["sub"], st["cus"], st["end"], st["updated"]) for u, st in state.items() if st["n"]}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs_equal_a_walk(spark, seed):
    """Few ids, so that users take them from each other; one id is everywhere."""
    rng = random.Random(seed)
    users = [_user(i, rng.choice([None, f"S{i}", "S0"]), rng.choice([None, f"C{i}"]), updated=rng.choice([None, 30])) for i in range(1, 7)]
    log = []
    for k in range(160):
        kind = rng.choice(["subscription.updated", "subscription.canceled", "transaction.completed"])
        data = {"status": rng.choice(["active", "past_due"])}
        if rng.random() < 0.25:
            data["custom_data"] = {"user_id": rng.randint(1, 8)}
        if rng.random() < 0.7:
            data["id" if kind.startswith("sub") else "subscription_id"] = "S" + str(rng.choice([0, 0, 0, *range(1, 9)]))
        if rng.random() < 0.4:
            data["customer_id"] = f"C{rng.randint(1, 8)}"
        if rng.random() < 0.2:
            data["email"] = f"u{rng.randint(1, 8)}@x.org"
        if rng.random() < 0.4:
            data["end"] = rng.randint(1, 99)
            data["current_billing_period"] = {"ends_at": _iso(60 * data["end"])}
        log.append((kind, k + rng.randint(-6, 6), {"data": data}))
    got = _state(spark, users, log)
    assert {u: tuple(list(r.values())[1:]) for u, r in got.items()} == _walk(users, log)


def test_least_holder_of_busy_keys(spark):
    rng = random.Random(3)
    spans = [(rng.choice(["hot", "hot", "hot", f"k{i % 9}"]), rng.randint(1, 40), since, rng.choice([FOREVER, since + rng.randint(1, 300)]))
             for i in range(400) for since in [rng.randint(-1, 900)]]
    points = [(i, rng.choice(["hot", "k1", "k2", "none"]), rng.randint(0, 1000)) for i in range(500)]
    got = least_holder(spark.createDataFrame(points, "point_id long, key string, at long"), spark.createDataFrame(spans, "key string, holder long, since long, until long"))
    want = {i: min(hs) for i, key, at in points if (hs := [h for k, h, a, b in spans if k == key and a < at <= b])}
    assert {r.point_id: r.holder for r in got.collect()} == want


def test_late_rounds_look_only_at_users_that_changed(spark, monkeypatch):
    """A chain of ids that each event learns from the one before, next to users whose events are settled at once."""
    seen, whole = [], s.applied_events
    monkeypatch.setattr(s, "applied_events", lambda resolved, users: seen.append(users.count()) or whole(resolved, users))
    monkeypatch.setattr(s, "FEW", 0)
    monkeypatch.setattr(s, "WRITE_EVERY", 2)
    log = [("subscription.updated", 10, {"data": {"id": f"S{i}"}}) for i in range(2, 12)]
    log += [("subscription.created", 20, {"data": {"custom_data": {"user_id": 1}, "id": "T0", "customer_id": "D1"}})]
    log += [("subscription.updated", 30 + i, {"data": {"id": f"T{i}", "customer_id": f"D{i + 1}", "customer": {"id": f"D{i}"}}}) for i in range(3)]
    log += [("subscription.updated", 40 + i, {"data": {"id": "T2", "subscription_id": f"T{i}"}}) for i in range(3)]
    users = [_user(1)] + [_user(i, f"S{i}") for i in range(2, 12)]
    got = _state(spark, users, log)
    assert len(got) == 11 and got[1]["subscription_id"] == "T2"
    assert seen[:2] == [11, 11] and len(seen) > 2 and max(seen[2:]) == 1
