"""Furthest neighbours, ways with parents, and detours against brute force."""

from __future__ import annotations

import heapq
import math
import random
from itertools import combinations

import pandas as pd
import pytest

from tidemark.functions.geo import EARTH_M
from tidemark.operators import routing as ro


def haversine(p, q):
    (x1, y1), (x2, y2) = ((math.radians(v) for v in r) for r in (p, q))
    return 2 * EARTH_M * math.asin(math.sqrt(min(1.0, math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2)))


def brute_pair(points):
    rows = [(haversine(p[1:], q[1:]), *sorted((p[0], q[0]))) for p, q in combinations(points, 2)]
    return max(rows) if rows else None


@pytest.mark.parametrize("seed", range(12))
def test_hull_holds_the_furthest_pair(seed):
    rng = random.Random(seed)
    spread = [0.01, 1.0, 40.0][seed % 3]
    points = [(i, rng.uniform(-spread, spread) + 10, rng.uniform(-spread, spread) + 20) for i in range(400)]
    if seed >= 9:
        points = [(i, 10 + spread * math.cos(i), 20 + spread * math.sin(i)) for i in range(400)]  # a ring: all corners
    frame = pd.DataFrame(points, columns=["node", "lon", "lat"])
    few = ro.hull(frame)
    assert len(few) < 60 or seed >= 9
    want, got = brute_pair(points), ro.furthest(few)
    assert got[0] == pytest.approx(want[0], rel=1e-12)


def test_same_places_and_few_points():
    frame = pd.DataFrame([(i, 5.0, 5.0) for i in range(9)], columns=["node", "lon", "lat"])
    assert ro.furthest(ro.hull(frame))[1:] == (7, 8)
    two = pd.DataFrame([(i, float(i % 2), 5.0) for i in range(10)], columns=["node", "lon", "lat"])
    assert ro.furthest(ro.hull(two))[1:] == (8, 9)
    assert ro.furthest(frame.head(1)) is None
    wide = pd.DataFrame([(0, 0.0, 0.0), (1, 180.0, 0.0), (2, 90.0, 0.0), (3, -90.0, 0.0), (4, 0.0, 90.0)], columns=["node", "lon", "lat"])
    assert ro.furthest(ro.hull(wide))[0] == pytest.approx(math.pi * EARTH_M)


def test_hubs_of_a_thousand_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ro, "MOST_POINTS", 100)  # so that hulls are merged
    rng = random.Random(3)
    rows = [(h, i, rng.gauss(0, 0.1) - 122, rng.gauss(0, 0.1) + 47) for h, n in ((1, 1000), (2, 250), (3, 2), (4, 1)) for i in range(n)] + [(5, 1, None, 4.0), (5, 2, 1.0, 4.0)]
    got = {r.hub: (r.a, r.b) for r in ro.furthest_pairs(spark.createDataFrame(rows, "hub long, node long, lon double, lat double")).collect()}
    assert got == {h: brute_pair([r[1:] for r in rows if r[0] == h])[1:] for h in (1, 2, 3)}


def dijkstra(edges, start, goal, shut=()):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    seen, queue = set(), [(0.0, start)]
    while queue:
        d, n = heapq.heappop(queue)
        if n == goal:
            return d
        if n not in seen:
            seen.add(n)
            for m, w in near.get(n, ()):
                if m not in shut:
                    heapq.heappush(queue, (d + w, m))
    return None


def test_corridor_detours(spark):
    rng = random.Random(11)
    places = [(i, rng.uniform(-1, 1), rng.uniform(46, 47)) for i in range(40)]
    links = {(*sorted(rng.sample(range(40), 2)), rng.randint(1, 9) / 2) for _ in range(45)}
    both = [(a, b, w) for a, b, w in links] + [(b, a, w) for a, b, w in links]
    shut = [3, 7, 11, 19, 23]
    made = ro.corridor_detours(spark.createDataFrame(places, "node long, lon double, lat double"), spark.createDataFrame(both, "src long, dst long, weight double"), spark.createDataFrame([(s,) for s in shut], "node long"))
    got = {r.hub: r for r in made.collect()}
    for hub in shut:
        near = {b for a, b, _ in both if a == hub and b not in shut}
        pair = brute_pair([places[n] for n in near])
        if pair is None:
            assert hub not in got
            continue
        _, a, b = pair
        usual, around = dijkstra(both, a, b), dijkstra(both, a, b, shut)
        assert (got[hub].a, got[hub].b, got[hub].nominal, got[hub].available) == (a, b, round(usual, 1), around is not None)
        assert got[hub].extra == (round(max(0.0, around - usual), 1) if around is not None else 0.0)
        if around is not None:
            way = got[hub].way
            cost = {(x, y): min(w for p, q, w in both if (p, q) == (x, y)) for x, y, _ in both}
            assert way[0] == a and way[-1] == b and sum(cost[s] for s in zip(way, way[1:])) == around and not set(way) & set(shut)


def test_ways_are_the_least_of_equal_ones(spark):
    square = [(1, 2, 1.0), (1, 3, 1.0), (2, 4, 1.0), (3, 4, 1.0), (4, 5, 1.0)]
    edges = spark.createDataFrame(square + [(b, a, w) for a, b, w in square], "src long, dst long, weight double")
    trips = spark.createDataFrame([("a", 1, 5), ("b", 5, 1), ("c", 1, 1), ("d", 1, 99)], "trip string, origin long, goal long")
    got = {r.trip: (r.weight, r.back) for r in ro.cheapest(edges, trips).collect()}
    assert got == {"a": (3.0, [5, 4, 2, 1]), "b": (3.0, [1, 2, 4, 5]), "c": (0.0, [1])}
