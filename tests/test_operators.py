"""Operators on hand-built rows: constants, ties, nulls, empty tables."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo, text as tx
from tidemark.operators import delta, graph as gr
from tidemark.operators import ledger, measures as ms, ordered as od, spatial as sp


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_geo(spark):
    r = one(
        spark, geo.haversine_m(F.lit(-122.335), F.lit(47.608), F.lit(-122.2015), F.lit(47.6101)).alias("d"), geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("b"),
        geo.geo_cell(F.lit(None).cast("double"), F.lit(1.0)).alias("c"), geo.point(F.lit(0.0), F.lit(0.0)).alias("p"),
        geo.area_m2(F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (0.001, 0.0), (0.001, 0.001), (0.0, 0.001))))).alias("a"),
    )
    assert r.d == pytest.approx(10012, rel=0.01) and r.b == pytest.approx(90) and r.c == "nogeo" and r.p is None and r.a == pytest.approx(111.32**2, rel=1e-3)


def test_polygons(spark):
    square = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [0.01, 0], [0.01, 0.01], [0, 0.01], [0, 0]]]})
    line = json.dumps({"type": "LineString", "coordinates": [[0, 0], [0.01, 0]]})
    rows = spark.createDataFrame([(1, 0.005, 0.005, square), (2, 0.02, 0.005, square), (3, 0.005, 0.001, line), (4, 0.0, 0.0, None)], "i int, lon double, lat double, g string")
    d = {r.i: r.d for r in rows.select("i", geo.distance_to_geometry_m("lon", "lat", "g").alias("d")).collect()}
    assert d[1] == 0 and d[2] == pytest.approx(1113.2, rel=0.01) and d[3] == pytest.approx(111.32, rel=0.01) and d[4] == float("inf")


@pytest.mark.parametrize(("url", "want"), [("HTTP://A.com/x/?utm_source=1&b=2#t", "http://a.com/x?b=2"), ("https://a.com/?ref=1", "https://a.com"), ("", ""), (None, ""), ("x", "x")])
def test_urls(spark, url, want):
    assert one(spark, tx.canonical_url(F.lit(url).cast("string")).alias("u")).u == want


def test_tokens(spark):
    r = one(spark, tx.tokens(F.lit("Crash on Interstate 5 at exit 163, blocked; SR-520 slow")).alias("a"), tx.tokens(F.lit("I-5 closed near the bridge")).alias("b"))
    assert {"i_5", "exit_163", "sr_520", "closure", "delay", "crash"} <= set(r.a) and "the" not in r.b
    s = one(spark, tx.entity_score(tx.tokens(F.lit("I-5 closed")), tx.tokens(F.lit("crash i-5"))).alias("s")).s
    assert s == pytest.approx(1.0)


@pytest.mark.parametrize(("said", "want"), [("1700000000", 1700000000), ("1700000000000", 1700000000), ("/Date(1700000000000)/", 1700000000), ("2023-11-14T22:13:20Z", 1700000000), ("Tue, 14 Nov 2023 22:13:20 +0000", 1700000000), ("soon", None), (None, None)])
def test_times(spark, said, want):
    assert one(spark, F.unix_seconds(tx.feed_time(F.lit(said).cast("string"))).alias("t")).t == want


def test_quantities(spark):
    r = one(spark, tx.quantity(F.lit("winds of 10 mph")).alias("a"), tx.quantity(F.lit("about 3.5 acres burnt")).alias("b"), tx.quantity(F.lit("none")).alias("c"))
    assert r.a.amount == pytest.approx(4.4704) and r.b.canonical == "m2" and r.c.value is None


def test_weighted_median(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("b", 1.0, 1), ("b", 5.0, 3), ("c", 7.0, 2), ("d", 420.0, 1)], "k string, v double, w long")
    got = {r.k: r.weighted_median for r in ms.weighted_median(rows, ["k"], "v", "w").collect()}
    assert got == {"a": 1.5, "b": 5.0, "c": 7.0, "d": 420.0}
    up = ms.upper_median_of(spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 9)], "k string, x long"), ["k"], "x")
    assert {r.k: r["median"] for r in up.collect()} == {"a": 3, "b": 9}
    assert ms.weighted_median(rows.limit(0), ["k"], "v", "w").count() == 0


def test_ledger(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 1), (None, "c", 5), (None, "d", 4)], "id long, v string, t long")
    assert {(r.id, r.v, r.t) for r in ledger.dedupe(rows, ["id"], ["t"]).collect()} == {(1, "a", 1), (2, "b", 1), (None, "d", 4)}
    assert {(r.id, r.t) for r in ledger.latest(rows, ["id"], ["t"]).collect()} == {(1, 2), (2, 1), (None, 5)}
    assert {r.id for r in ledger.append_new(rows.where("id = 1"), rows.where("id IS NOT NULL"), "id", ["t"]).collect()} == {2}
    v = ledger.versions(spark.createDataFrame([(1, i, f) for i, f in enumerate(["x", "x", "y", None, None, "x"])], "id long, t long, f string"), ["id"], ["t"], "f")
    assert [r.version for r in v.orderBy("t").collect()] == [1, 1, 2, 3, 3, 4]


def test_as_of(spark):
    states = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "k long, t long, s string")
    probes = spark.createDataFrame([(100, 1, 9), (101, 1, 10), (102, 1, 25), (103, 2, 5), (104, 3, 5)], "p long, k long, at long")
    got = {r.p: r.s for r in ledger.as_of(probes, states, "k", "at", "t", ["s"]).collect()}
    assert got == {100: None, 101: "a", 102: "b", 103: "c", 104: None}


def test_change_points():
    x = np.concatenate((np.zeros(10), np.full(10, 5.0))) + np.sin(np.arange(20)) * 0.1
    assert 8 <= od.change_points(x)[0] <= 12 and od.change_points(x[:7]) == [] and od.change_points(np.ones(20)) == []


def test_silence(spark):
    cases = [(10.0, 5, 6, 900.0), (1000.0, 5, 6, 8000.0), (9000.0, 5, 6, 21600.0), (10.0, 1, 6, 21600.0), (10.0, 5, 2, 21600.0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, g double, m long, n long, want double")
    assert all(r.t == r.want for r in rows.select("want", od.silence_threshold(F.col("g"), F.col("m"), F.col("n")).alias("t")).collect())


def test_spatial_joins(spark):
    rng = np.random.default_rng(2)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform((-122.4, 47.5), (-122.2, 47.7), (80, 2)))]
    left, right = spark.createDataFrame(a[:40], "a int, lon double, lat double"), spark.createDataFrame(a[40:], "b int, lon double, lat double")

    def d(p, q):
        u = np.radians([p[1], p[2], q[1], q[2]])
        h = np.sin((u[3] - u[1]) / 2) ** 2 + np.cos(u[1]) * np.cos(u[3]) * np.sin((u[2] - u[0]) / 2) ** 2
        return 2 * 6371008.8 * np.arcsin(np.sqrt(h))

    got = {(r.a, r.b) for r in sp.within_distance(left, right, 3000.0).collect()}
    assert got == {(p[0], q[0]) for p in a[:40] for q in a[40:] if d(p, q) <= 3000}
    near = {r.a: r.b for r in sp.nearest(left, right, "a", "b", 500.0).collect()}
    assert near == {p[0]: min(a[40:], key=lambda q: (d(p, q), q[0]))[0] for p in a[:40]}


def test_contradictions(spark):
    claims = spark.createDataFrame([(1, "road", "open"), (1, "road", "closed"), (1, "road", "closed"), (2, "road", "open"), (3, "x", None)], "s long, p string, v string")
    assert [tuple(r) for r in sp.contradictions(claims, "s", "p", "v", [("open", "closed")]).collect()] == [(1, "road", "open", "closed")]


GRID = [("N1", "N2"), ("N2", "N4"), ("N1", "N3"), ("N3", "N4")]


def test_routes(spark):
    edges = gr.both_ways(spark.createDataFrame([(a, b, w) for (a, b), w in zip(GRID, (1.0, 1.0, 2.0, 2.0))], "src string, dst string, weight double"))
    start = spark.createDataFrame([("N1",)], "node string")
    assert {r.node: r.weight for r in gr.shortest_paths(edges, start).collect()} == {"N1": 0, "N2": 1, "N3": 2, "N4": 2}
    assert {r.node for r in gr.shortest_paths(edges, start, limit=1.0).collect()} == {"N1", "N2"}
    r = gr.detour(edges, start, "N4", spark.createDataFrame([("N2",)], "node string")).first()
    assert (r.nominal, r.around, r.extra) == (2, 4, 2)
    cut = gr.detour(edges, start, "N4", spark.createDataFrame([("N2",), ("N3",)], "node string")).first()
    assert cut.around is None
    assert {r.node: r.hops for r in gr.propagate(edges, start, 1, 9.0).collect()} == {"N1": 0, "N2": 1, "N3": 1}


def test_metrics(spark):
    rows = spark.createDataFrame(list(zip([0.9, 0.8, 0.2, 0.1, 0.7], [1, 1, 0, 0, 1])), "p double, y int")
    assert rows.agg(ms.brier(F.col("p"), F.col("y")).alias("b")).first().b == pytest.approx(0.038)
    assert 0 <= ms.calibration_error(rows, "p", "y").first().ece <= 0.3
    c = rows.agg(*(v.alias(k) for k, v in ms.confusion(F.col("p"), F.col("y")).items())).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (3, 0, 0, 2)


def test_greedy_clusters(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (2, 0, 60.0, 0.001, 0.0), (3, 0, 90.0, 1.0, 0.0), (4, 0, 99999.0, 0.0, 0.0)], "k long, r long, at double, lon double, lat double")
    got = {r.k: r.seed for r in gr.greedy_clusters(rows, "r", "at", "lon", "lat", "k", 1800.0, 14400.0).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_small_ring_keeps_its_area(spark):
    side = 1e-4
    corners = [(-122.3, 47.6), (-122.3 + side, 47.6), (-122.3 + side, 47.6 + side), (-122.3, 47.6 + side)]
    row = spark.createDataFrame([(corners,)], "ring array<struct<lon:double,lat:double>>").select(geo.area_m2(F.col("ring")).alias("a")).first()
    lat = sum(y for _, y in corners) / 4
    assert row.a == pytest.approx((corners[1][0] - corners[0][0]) * (corners[2][1] - corners[1][1]) * 111320.0**2 * math.cos(math.radians(lat)), rel=1e-6)


def test_capped_weights_against_rows(spark):
    rows = [("a", 1.0, 90), ("a", 2.0, 3), ("a", 2.0, 4), ("b", 5.0, 7), ("c", 1.0, 5), ("c", 2.0, 5), ("d", 3.0, 50), ("d", 3.0, 2), ("d", 4.0, 9)]
    got = {(r.g, r.v): r.w for r in ms.capped_weights(spark.createDataFrame(rows, "g string, v double, w long"), ["g"], "v", "w").collect()}
    want: dict = {}
    for g, v, w in rows:
        rest = sum(x for h, _, x in rows if h == g) - w
        want[g, v] = want.get((g, v), 0) + min(w, max(1, rest))
    assert got == want


def test_geometry_and_heading_of_versions(spark):
    states = spark.createDataFrame([("e", 1, 0.0, 0.0, 0.0), ("e", 2, 0.0, 0.0, 100.0), ("e", 3, 1.0, 0.0, 100.0), ("e", 4, 1.0, 0.0, 101.0), ("f", 1, None, None, None), ("f", 2, 0.0, 0.0, 0.0)], "k string, v int, lon double, lat double, area double")
    got = sorted(tuple(r) for r in delta.geometry(states, "k", "v").collect())
    assert got == [("e", 2, "event_footprint_expanded", 0.4), ("e", 3, "event_geometry_displaced", 0.6)]
    nowhere = F.lit(None).cast("double")
    assert one(spark, geo.haversine_m(nowhere, F.lit(1.0), F.lit(2.0), F.lit(1.0)).alias("d")).d is None
    assert one(spark, delta.displacement(nowhere, nowhere, F.lit(1.0), F.lit(1.0)).alias("d")).d == 0.0
    moves = spark.createDataFrame([(1, False, None), (2, True, 350.0), (3, True, 10.0), (4, True, 50.0), (5, True, 50.0), (6, False, None)], "v int, moving boolean, direction double").withColumn("k", F.lit(1))
    got = [tuple(r)[1:] for r in delta.heading(moves, "k", "v").orderBy("v").collect()]
    assert got == [(2, "movement_started", 0.7), (3, "movement_started", 0.7), (4, "event_direction_changed", 0.7), (6, "movement_stopped", 0.35)]


def test_ordered_analytics_by_buckets(spark):
    """A hot key's rows are sorted bucket by bucket, with the same results as windows over the key; nulls and ties included."""
    import random

    from pyspark.sql import Window

    from tidemark.operators import ordered

    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 9 + ["b", None]), rng.choice([None, *range(0, 900, 7)]) if rng.random() < 0.5 else rng.randrange(900), i, rng.choice([None, 1, 5])) for i in range(700)]
    frame = spark.createDataFrame(rows, "k string, t long, i long, v long").repartition(3)
    by = Window.partitionBy("k").orderBy("t", "i")
    plain = {r.i: (r.a, r.b) for r in frame.select("i", F.lag("i").over(by).alias("a"), F.lag("v").over(by).alias("b")).collect()}
    got = ordered.lagged(frame, ["k"], ["t", "i"], ["v"], bucket=50)
    assert sorted(got.columns) == ["__before", "i", "k", "t", "v"]
    assert {r.i: (r["__before"].i, r["__before"].v) if r["__before"] else (None, None) for r in got.collect()} == plain
    plain = {r.i: r.s for r in frame.select("i", F.sum("v").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("s")).collect()}
    assert {r.i: r.v for r in ordered.running(frame, ["k"], ["t", "i"], ["v"], bucket=50).collect()} == plain
    sizes = frame.where("t IS NOT NULL").groupBy("k", F.floor(F.col("t") / 50)).count().agg(F.max("count")).first()[0]
    assert sizes < 60 < frame.where("k = 'hot'").count()
    plan = ordered.running(frame, ["k"], ["t", "i"], ["v"], bucket=50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2  # one over buckets, one over their totals

    points = spark.createDataFrame([(j, "hot", t) for j, t in enumerate(range(-20, 950, 13))], "j long, k string, at long")
    told = {r.j: (r.n, r.v) for r in ordered.counted_at(frame.withColumn("n", F.lit(1).cast("long")), points, "k", "t", ["n", "v"], bucket=50).collect()}
    hot = [r for r in rows if r[0] == "hot"]
    for j, t in enumerate(range(-20, 950, 13)):
        seen = [r for r in hot if r[1] is None or r[1] <= t]
        assert (told[j][0] or 0, told[j][1] or 0) == (len(seen), sum(r[3] or 0 for r in seen))


def test_as_of_by_buckets(spark):
    import random

    rng = random.Random(9)
    probes = [(i, rng.choice("ab"), rng.randrange(1000)) for i in range(300)]
    states = [(k, t, t * 10) for k in "ab" for t in rng.sample(range(1000), 25)]
    got = ledger.as_of(spark.createDataFrame(probes, "p long, k string, at long"), spark.createDataFrame(states, "k string, t long, s long"), "k", "at", "t", ["s"], bucket=40).collect()
    want = {p: max(((t, s) for k2, t, s in states if k2 == k and t <= at), default=(None, None)) for p, k, at in probes}
    assert {r.p: (r.t, r.s) for r in got} == want
