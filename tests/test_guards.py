"""Guards of content, alternatives of routes and meeting segments against definitions and brute force."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from tidemark.functions import guards as gd, text as tx
from tidemark.operators import routing as ro, spatial as sp


def test_guards(spark):
    rows = spark.createDataFrame([("Shelter in place now",), ("All calm",), (None,)], "t string")
    assert [r[0] for r in rows.select(gd.prohibited(F.col("t"))).collect()] == ["independent_evacuation_directive", None, None]
    one = spark.range(1)
    fields = F.create_map(F.lit("tier"), F.lit("evacuation"), F.lit("note"), F.lit("the bridge is closed"), F.lit("ok"), F.lit("fine"))
    assert one.select(gd.kept_fields(fields)).first()[0] == {"tier": "evacuation", "ok": "fine"}
    assert one.select(gd.kept_items(F.array(F.lit("the group is armed"), F.lit("calm")))).first()[0] == ["calm"]
    plain = F.create_map(F.lit("note"), F.lit("open_modal"))
    assert one.select(gd.directive(F.lit("a slideshow_1"), F.lit(None).cast("string"), plain)).first()[0] is None


def test_affected_routes_take_24_at_most(spark):
    said = "affected routes: " + ", ".join(map(str, range(30)))
    assert spark.createDataFrame([(said,)], "t string").select(tx.affected_routes(F.col("t"))).first()[0] == [str(n) for n in range(24)]


def test_alternatives(spark):
    """Against all simple ways of a small graph, for every pair of its nodes, with equal weights and a closed node."""
    rnd = random.Random(5)
    links = {(a, b): rnd.randint(1, 3) / 1.0 for a, b in itertools.permutations(range(7), 2) if rnd.random() < 0.4}
    out = {n: [b for a, b in links if a == n] for n in range(7)}

    def ways(path, goal):
        if path[-1] == goal:
            yield path
        else:
            for n in out[path[-1]]:
                if n not in path:
                    yield from ways([*path, n], goal)

    cost = lambda p: sum(links[e] for e in zip(p, p[1:]))
    want = {}
    trips = list(itertools.permutations(range(7), 2))
    for trip, (a, b) in enumerate(trips):
        barred, every = [], list(ways([a], b))
        for rank in (1, 2, 3):
            fit = [p for p in every if 3 not in p and not any(e in barred for e in zip(p, p[1:]))]
            if not fit:
                break
            best = min(fit, key=lambda p: (cost(p), p[::-1]))
            want[trip, rank] = (best, cost(best), round(max(0.0, cost(best) - min(map(cost, every))), 1))
            if len(best) <= 2:
                break
            barred.append((best[len(best) // 2], best[len(best) // 2 + 1]))
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "src long, dst long, weight double")
    asked = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(trips)], "trip long, origin long, goal long")
    got = ro.alternatives(edges, asked, spark.createDataFrame([(3,)], "node long")).collect()
    assert {(r["trip"], r["rank"]): (r["path"], r["weight"], r["extra"]) for r in got} == want


def test_redundancy(spark):
    nodes = spark.createDataFrame([(1, "arterial"), (2, "arterial"), (3, "local"), (4, "arterial")], "node long, class string")
    blocked = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 1, 2), ("b", 3, 0), ("b", 1, 1), ("c", 9, 0)], "event string, node long, place long")
    assert {r[0]: r[1] for r in ro.redundancy(nodes, blocked, "event").collect()} == {"a": 0.3333, "b": 0.75, "c": 0.75}


def test_meeting_segments(spark):
    """Whole numbers, so that touching ends and overlaps on one line are exact; each pair once, over many cells."""
    rnd = random.Random(3)
    some = lambda n: [(i, *(float(rnd.randint(0, 9)) for _ in range(4))) for i in range(n)]
    left, right = some(40), [*some(40), (99, None, 1.0, 2.0, 3.0)]
    side = lambda s, x, y: (s[3] - s[1]) * (y - s[2]) - (s[4] - s[2]) * (x - s[1])

    def meet(a, b):
        if any(max(min(a[i], a[i + 2]), min(b[i], b[i + 2])) > min(max(a[i], a[i + 2]), max(b[i], b[i + 2])) for i in (1, 2)):
            return False
        return side(b, *a[1:3]) * side(b, *a[3:]) <= 0 and side(a, *b[1:3]) * side(a, *b[3:]) <= 0

    want = sorted((a[0], b[0]) for a in left for b in right if None not in b and meet(a, b))
    shape = "id long, lon1 double, lat1 double, lon2 double, lat2 double"
    l, r = (spark.createDataFrame(rows, shape.replace("id", key)) for rows, key in ((left, "a"), (right, "b")))
    assert sorted(map(tuple, sp.meeting(l, r, "a", "b", 2.0).collect())) == want
