"""Alert policies with feedback against a list of everything sent."""

from __future__ import annotations

import random

import pytest

from tidemark.operators import feedback as fb

SCHEMA = "alert_id long, user_id string, us long, event_id long, dedupe_key string, urgency int, official boolean"


def brute(rows, limit, limit_us, repeat_us, dedupe_us):
    sent, out = [], []
    for alert, user, us, event, key, urgency, official in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        mine = [s for s in sent if s[0] == user]
        on_event = [s for s in mine if s[2] == event and s[1] >= us - repeat_us]
        rank = -(2**31) if urgency is None else urgency
        if any(s[3] == key and s[1] >= us - dedupe_us for s in mine):
            decision = fb.DUPLICATE
        elif official:
            decision = fb.BYPASS
        elif on_event and rank <= on_event[-1][4]:
            decision = fb.EQUIVALENT
        elif 0 < limit <= sum(s[1] >= us - limit_us for s in mine):
            decision = fb.LIMITED
        else:
            decision = fb.SENT
        if decision in (fb.SENT, fb.BYPASS):
            sent.append((user, us, event, key, rank))
        out.append((alert, user, decision))
    return sorted(out, key=str)


def made(seed, n=400):
    rng, at, out = random.Random(seed), 10**15, []
    for i in range(n):
        at += rng.choice([0, 1, 5, 20, 20, 700])
        user = rng.choice(["hot"] * 5 + ["b", "c", None])
        out.append((i, user, None if rng.random() < 0.02 else at, rng.choice([1, 2, 3, None]), rng.choice(["x", "y", "z", f"k{i}", f"k{i}", None]), rng.choice([0, 1, 2, None]), rng.choice([False] * 8 + [True, None])))
    return out


@pytest.mark.parametrize(("seed", "windows"), [(1, (2, 60, 40, 100)), (2, (0, 60, 40, 10)), (3, (1, 5, 300, 0)), (4, (3, 25, 25, 25))])
def test_by_brute_force(spark, seed, windows):
    rows = made(seed)
    got = fb.sent_alerts(spark.createDataFrame(rows, SCHEMA).repartition(3), *windows).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, *windows)


def test_a_busy_user_is_cut_at_silences(spark):
    rows = [(i, "hot", 10**15 + (i // 50) * 10_000 + i % 50, i, f"k{i}", 0, False) for i in range(1000)]
    cut = fb.segments(spark.createDataFrame(rows, SCHEMA), "user_id", "us", 100)
    sizes = [r["count"] for r in cut.groupBy("user_id", "segment").count().collect()]
    assert len(sizes) == 20 and max(sizes) == 50


def test_state_holds_the_windows_only():
    policy = fb.Policy(3, 100, 100, 100)
    for i in range(20_000):
        policy.decide(i * 10, i, f"k{i}", 0, False)
    assert len(policy.by_event) + len(policy.keys) < 200 and len(policy.sent) <= 3


def test_no_candidates(spark):
    assert fb.sent_alerts(spark.createDataFrame([], SCHEMA), 1, 1, 1, 1).count() == 0
