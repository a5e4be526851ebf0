"""State with timers against plain loops, over one and over many micro-batches; states stay bounded."""

from __future__ import annotations

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalogue
from tidemark.streaming import ledger_stream as ls
from tidemark.streaming import timers as tm

MIN = 60_000_000
ROWS = "cell string, observation_id long, us long, lon double, lat double, final boolean"
POLLS = "feed string, record long, us long, fingerprint string"


def drained(spark, tmp_path, rows, schema, make, pieces):
    """The stream over ``rows`` in so many micro-batches, started again for each; with the state's rows at the end."""
    step, held = -(-len(rows) // pieces), None
    for k in range(pieces):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).repartition(2).write.parquet(str(tmp_path / f"in/{k}"))
        stream = ls.read_files(spark, str(tmp_path / "in/*"), schema)
        with tm.timed_state(spark):
            q = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).queryName("q" + uuid.uuid4().hex).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]
    return spark.read.schema(make(stream).schema).parquet(str(tmp_path / "out")), held


def brute(rows, silence, margin, radius):
    """Events of each cell in a list, all looked at for every observation."""
    events, out = {}, []
    for cell, o, us, lon, lat, final in sorted(rows, key=lambda r: (r[2], r[1])):
        near = []
        for e in events.setdefault(cell, []):
            d = math.hypot((lon - e["x"]) * 111320.0 * math.cos(math.radians(lat)), (lat - e["y"]) * 111320.0) if radius else 0.0
            if us - e["last"] <= margin and (not radius or d <= radius):
                near.append((d, -e["last"], e["id"], e))
        usable = [n for n in near if us - n[3]["last"] <= silence or not n[3]["final"]]
        if usable:
            e = min(usable, key=lambda n: n[:3])[3]
            out.append((cell, o, e["id"], "linked" if us - e["last"] <= silence else "reopened"))
            e.update(last=us, final=final)
        else:
            out.append((cell, o, o, "new" if near else "opened"))
            events[cell].append({"id": o, "x": lon, "y": lat, "last": us, "final": final})
    return sorted(out)


def made(n, seed):
    rng, at, out = random.Random(seed), 1_700_000_000_000_000, []
    for i in range(n):
        at += rng.choice([0, MIN, 10 * MIN, 40 * MIN])
        out.append((rng.choice("abc"), i, at, rng.randrange(5) * 0.003, 47 + rng.randrange(3) * 0.003, rng.random() < 0.3))
    return out


@pytest.mark.parametrize("radius", [None, 400.0])
def test_resolver_by_brute_force(spark, tmp_path, radius):
    rows = made(250, 3)
    want = brute(rows, 60 * MIN, 300 * MIN, radius)
    for pieces in (1, 3):
        got, held = drained(spark, tmp_path / str(pieces), rows, ROWS, lambda s: tm.resolve(s, "cell", 60 * MIN, 300 * MIN, radius, "1 second"), pieces)
        assert sorted(tuple(r)[:4] for r in got.where("observation_id IS NOT NULL").collect()) == want
        closures = got.where("observation_id IS NULL").collect()
        assert closures and all(r.outcome == "closed" for r in closures)
        reopened = sum(1 for w in want if w[3] == "reopened")
        opened = sum(1 for w in want if w[3] in ("opened", "new"))
        assert reopened <= len(closures) <= reopened + opened  # each reopening follows a closure
        assert 0 < held < 60  # events out of reach and their timers are gone


def test_cells_share_state_rows(spark, tmp_path, monkeypatch):
    """Many cells, one without a name, with ids that a double can't hold: a group's cells stay apart in one row of the state."""
    monkeypatch.setattr(tm, "GROUPS", 4)
    rng, at, big, rows = random.Random(4), 1_700_000_000_000_000, 2**53 + 1, []
    for i in range(400):
        at += rng.choice([0, MIN, 4 * MIN])
        rows.append((rng.choice([0, *range(big, big + 39)]), big + i, at, 0.0, 47.0, rng.random() < 0.3))
    want = brute(rows, 60 * MIN, 300 * MIN, None)
    given = [(r[0] or None, *r[1:]) for r in rows]
    for pieces in (1, 2):
        got, held = drained(spark, tmp_path / str(pieces), given, ROWS.replace("cell string", "cell long"), lambda s: tm.resolve(s, "cell", 60 * MIN, 300 * MIN, None, "1 second"), pieces)
        assert sorted((r.cell or 0, *tuple(r)[1:4]) for r in got.where("observation_id IS NOT NULL").collect()) == want
        assert {w[3] for w in want} == {"opened", "new", "linked", "reopened"} and 0 < held <= 5


def test_resolver_rows_without_time_or_place(spark, tmp_path):
    at = 1_700_000_000_000_000
    rows = [("a", 1, at, 0.0, 47.0, False), ("a", 2, None, 0.0, 47.0, False), ("a", None, at, 0.0, 47.0, None), ("a", 3, at, None, 47.0, None), (None, 4, at, 0.0, 47.0, None), ("a", 1, at, 0.0, 47.0, False)]
    got, _ = drained(spark, tmp_path, rows, ROWS, lambda s: tm.resolve(s, "cell", MIN, MIN, 10.0, "1 second"), 1)
    assert sorted((r.cell or "", r.observation_id, r.outcome) for r in got.collect()) == [("", 4, "opened"), ("a", 1, "linked"), ("a", 1, "opened")]


def test_registered_resolver_by_brute_force(spark, sf_dir):
    got = catalogue.queries()["stream_resolver"](spark, sf_dir).collect()
    from tidemark.functions import geo
    from tidemark.plans.registry import Tables

    obs = Tables(spark, sf_dir).obs.select(geo.geo_cell(F.col("lon"), F.col("lat")), "observation_id", "us", "lon", "lat", F.col("k") >= 95).collect()
    assert sorted(tuple(r)[:4] for r in got) == brute([tuple(r) for r in obs], 60 * MIN, 180 * MIN, 500.0)


def brute_presence(rows, missed, until):
    out, seen = [], {}
    for feed, record, us, fp in sorted(rows, key=lambda r: (r[2], r[3])):
        s = seen.get((feed, record))
        if s is None:
            seen[feed, record] = [us, fp, 1]
            out.append((feed, record, "created", 1, us))
            continue
        gone = us - s[0] > missed
        if gone:
            out.append((feed, record, "ended", s[2], s[0] + missed))
        s[2] += fp != s[1]
        if gone or fp != s[1]:
            out.append((feed, record, "returned" if gone else "revised", s[2], us))
        s[:2] = us, fp
    return sorted(out + [(*k, "ended", s[2], s[0] + missed) for k, s in seen.items() if until - s[0] > missed])


def test_records_end_by_timer_and_return(spark, tmp_path):
    rng, start = random.Random(5), 1_700_000_000_000_000
    rows = [(f, r, start + d * MIN, rng.choice("pq")) for d in range(40) for f in "xy" for r in range(6) if rng.random() < 0.35]
    want = brute_presence(rows, 3 * MIN, max(r[2] for r in rows))
    for pieces in (1, 4):
        got, _ = drained(spark, tmp_path / str(pieces), rows, POLLS, lambda s: tm.presence(s, ["feed", "record"], 3 * MIN, 1000 * MIN, "1 second"), pieces)
        assert sorted(map(tuple, got.collect())) == want


def test_ended_records_leave_the_state(spark, tmp_path):
    start = 1_700_000_000_000_000
    rows = [("x", r, start + r * MIN, "p") for r in range(300)]
    got, held = drained(spark, tmp_path, rows, POLLS, lambda s: tm.presence(s, ["feed", "record"], 3 * MIN, 10 * MIN, "1 second"), 3)
    assert got.where("change = 'created'").count() == 300 and got.where("change = 'ended'").count() >= 290 and held < 40
