"""Every registered query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import decimal
import math
from collections import Counter

import duckdb
import pytest

from tidemark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    value = lambda v: float(v) if isinstance(v, decimal.Decimal) else 0.0 if v == 0 and isinstance(v, float) else v
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(map(value, r)) for r in rows), key=key)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert plain(got.select(*cols).collect()) == plain(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


#: Queries that SQL can't say; each has a test against brute force, here or where it says.
BRUTE = {"situation_clusters", "unresolved_clusters", "regime_change_points", "stream_tumbling", "stream_resolver"}  # the last in test_timers


def test_every_query_has_an_oracle_or_brute_force():
    assert set(QUERIES) - set(ORACLES) == BRUTE


@pytest.fixture(scope="module")
def obs(spark, sf_dir):
    from tidemark.plans.registry import Tables

    return Tables(spark, sf_dir).obs.collect()


def metres(a, b):
    r = math.radians
    s = math.sin(r(b.lat - a.lat) / 2) ** 2 + math.cos(r(a.lat)) * math.cos(r(b.lat)) * math.sin(r(b.lon - a.lon) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(min(1.0, s)))


def test_situation_clusters(spark, sf_dir, obs):
    seeds, want = {}, {}
    for o in sorted(obs, key=lambda o: (o.us / 1e6, o.observation_id)):
        near = seeds.setdefault(o.source_id % 25, [])
        hit = next((s for s in near if (o.us - s.us) / 1e6 <= 14400 and math.hypot((o.lon - s.lon) * 111320.0 * math.cos(math.radians(s.lat)), (o.lat - s.lat) * 111320.0) <= 1800), None)
        want[o.observation_id] = (hit or o).observation_id
        if hit is None:
            near.append(o)
    assert {r.observation_id: r.seed for r in QUERIES["situation_clusters"](spark, sf_dir).collect()} == want


def test_unresolved_clusters(spark, sf_dir, obs):
    label = {o.observation_id: o.observation_id for o in obs}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    rows = sorted(obs, key=lambda o: o.lat)
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if b.lat - a.lat > 0.0136:
                break
            if abs(a.lon - b.lon) < 0.021 and metres(a, b) <= 1500:
                x, y = top(a.observation_id), top(b.observation_id)
                label[max(x, y)] = min(x, y)
    want = {o.observation_id: top(o.observation_id) for o in obs}
    got = QUERIES["unresolved_clusters"](spark, sf_dir).collect()
    assert {r.observation_id: r.component for r in got} == want
    sessions, last = {}, {}
    for o in sorted(obs, key=lambda o: (o.us, o.observation_id)):
        c = want[o.observation_id]
        if c in last and o.us - last[c] > 7_200_000_000:
            sessions[c] = sessions.get(c, 0) + 1
        last[c] = o.us
        label[o.observation_id] = (c, sessions.get(c, 0))
    # sessions are numbered in order; the same rows share one
    found = {}
    for r in got:
        found.setdefault((r.component, r.session), set()).add(r.observation_id)
    same = {}
    for i, k in label.items():
        same.setdefault(k, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, same.values()))


def test_regime_change_points(spark, sf_dir, obs):
    import numpy as np

    daily = {}
    for o in obs:
        day = daily.setdefault(o.source_id, {})
        day[o.us // 86_400_000_000] = day.get(o.us // 86_400_000_000, 0.0) + o.value

    def cost(x):
        return float(((x - x.mean()) ** 2).sum())

    want = set()
    for source, days in daily.items():
        x = np.array([days[d] for d in sorted(days)])
        n = len(x)
        if n < 8:
            continue
        penalty = 2 * math.log(n) * max(float(x.var()), 1e-12)
        best, back = [-penalty] + [math.inf] * n, [0] * (n + 1)
        for end in range(2, n + 1):
            for start in range(end - 1):
                if best[start] + cost(x[start:end]) + penalty < best[end] - 1e-9:
                    best[end], back[end] = best[start] + cost(x[start:end]) + penalty, start
        at = n
        while back[at]:
            at = back[at]
            want.add((source, at))
    assert {(r.source_id, r.change_at) for r in QUERIES["regime_change_points"](spark, sf_dir).collect()} == want


def test_stream_tumbling(spark, sf_dir, obs):
    hour = 3_600_000_000
    closed = max(o.us for o in obs) - 600_000_000
    want = Counter((o.us // hour * hour, o.kind) for o in obs if o.us // hour * hour + hour <= closed)
    from pyspark.sql import functions as F

    got = QUERIES["stream_tumbling"](spark, sf_dir).select(F.unix_micros("start").alias("us"), "event_type", "n").collect()
    assert {(r.us, r.event_type): r.n for r in got} == want
