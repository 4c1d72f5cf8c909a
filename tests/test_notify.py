"""Notification flushes against a plain timer walk."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import notify as nt

S = 1_000_000


def walk(events, wait, every, repeat, now):
    """One group, timer by timer: events ``(time, id, member, status)`` in order."""
    out, i = [], 0
    events = sorted(events)
    while i < len(events):
        tick, state, sent = events[i][0] + wait, {}, None
        while tick <= now:
            changed = False
            while i < len(events) and events[i][0] <= tick:
                _, _, member, status = events[i]
                changed |= state.get(member) != status
                state[member] = status
                i += 1
            firing = sum(v == "firing" for v in state.values())
            if changed:
                out.append((tick, len(state), firing, "initial" if sent is None else "change"))
                sent = tick
                state = {k: v for k, v in state.items() if v == "firing"}
            elif firing and tick - sent >= repeat:
                out.append((tick, len(state), firing, "repeat"))
                sent = tick
            if not state:
                break
            tick += every
        else:
            break
    return out


def frame(spark, groups):
    rows = [(m, s, t, i, {"alertname": g, "instance": "h"}) for g, events in groups.items() for t, i, m, s in events]
    return spark.createDataFrame(rows, "fingerprint string, status string, received_us long, event_id long, labels map<string,string>")


def transitions(events):
    last, out = {}, []
    for t, i, m, s in sorted(events):
        if last.get(m) != s:
            out.append((t, i, m, s))
        last[m] = s
    return out


@pytest.mark.parametrize(("wait", "every", "repeat", "bucket"), [(10, 30, 300, 60), (45, 20, 130, 90), (1, 7, 10_000, 50), (3, 3, 5, 1000)])
def test_flushes_equal_the_walk(spark, wait, every, repeat, bucket):
    rng = random.Random(wait)
    groups = {}
    for g in range(40):
        t, events = 1000 * S, []
        for i in range(rng.randint(1, 60)):
            t += rng.choice([0, 1, 2, 5, 11, 30, 31, 90, 700]) * S * rng.choice([1, 1, 1, 0])
            events.append((t, 1000 * g + i, f"m{g}-{rng.randrange(rng.choice([1, 2, 4]))}", rng.choice(["firing", "resolved", "resolved"])))
        groups[f"g{g}"] = events
    now = 4000 * S
    got = {}
    for r in nt.alert_notify(frame(spark, groups), now, f"{wait}s", f"{every}s", f"{repeat}s", bucket_us=bucket * S).collect():
        got.setdefault(r.alertname, []).append((r.flush_us, r.n_alerts, r.n_firing, r.reason))
    for g, events in groups.items():
        assert sorted(got.get(g, [])) == walk(transitions(events), wait * S, every * S, repeat * S, now), g


def test_a_hot_group_is_many_tasks(spark):
    rng = random.Random(2)
    events = [(i * S // 2, i, f"m{rng.randrange(6)}", rng.choice(["firing", "resolved"])) for i in range(6000)]
    f = frame(spark, {"hot": events})
    got = nt.alert_notify(f, 3600 * S, "10s", "30s", "4h", bucket_us=120 * S)
    want = walk(transitions(events), 10 * S, 30 * S, 14_400 * S, 3600 * S)
    assert sorted((r.flush_us, r.n_alerts, r.n_firing, r.reason) for r in got.collect()) == want and len(want) > 50
    # Its rows are dealt by stretch, and what is walked in order is a small map of each.
    assert f.select(F.floor(F.col("received_us") / F.lit(120 * S))).distinct().count() == 25
    s = nt.Stretch(*map(__import__("numpy").array, ([0, 5, 50, 51, 52], [1, 0, 1, 0, 1])), 60, 10, 30)
    low, high, out = s.map()
    assert list(zip(low, high)) == sorted(zip(low, high)) and len(low) <= 6


def test_no_events(spark):
    assert nt.alert_notify(frame(spark, {}), 5).count() == 0
