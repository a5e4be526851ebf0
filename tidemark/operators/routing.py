"""Ways of many trips at once: cheapest ways, alternatives round closures, travel times, redundancy."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M
from .graph import kept

# fixed values: metres a minute on arterial and other ways, least minutes of a step, minutes of a step without places
ARTERIAL, LOCAL, LEAST_STEP, UNPLACED_STEP = 550.0, 350.0, 0.5, 1.5


def without(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """Edges that touch none of the closed nodes."""
    return edges.join(closed.select(F.col("node").alias("src")), "src", "left_anti").join(closed.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "weight")


def _traced(state: DataFrame, ways: DataFrame) -> DataFrame:
    """(trip, goal, weight, back) of arrived ``ways``: each followed back from its goal by the parents in ``state``."""
    parents = state.select("trip", "node", "parent")
    at = ways.select("trip", "node", F.lit(0).alias("place"))
    steps = [at]
    for place in itertools.count(1):
        at = kept(at.join(parents, ["trip", "node"]).where("parent IS NOT NULL").select("trip", F.col("parent").alias("node"), F.lit(place).alias("place")))
        if at.isEmpty():
            break
        steps.append(at)
    every = steps[0]
    for more in steps[1:]:
        every = every.unionByName(more)
    back = every.groupBy("trip").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda p: p["node"]).alias("back"))
    return ways.join(back, "trip").select("trip", "goal", "weight", "back")


def cheapest(edges: DataFrame, trips: DataFrame, barred: DataFrame | None = None) -> DataFrame:
    """(trip, goal, weight, back): the cheapest way of each trip (trip, origin, goal) that has one.

    ``back`` lists its nodes from the goal; of equally cheap ways the one whose list is least.  ``barred`` (trip, src, dst)
    are edges that a trip may not take.  All trips relax together, one join and one aggregation a round; a trip goes on
    only from nodes that got better and are nearer than its goal so far.  The state is a weight and a parent for each trip
    and node that it reached; ways are followed back at the end.  Weights must be above zero."""
    if not edges.where("weight <= 0").isEmpty():
        raise ValueError("cheapest needs weights above zero")
    none = F.lit(None).cast(edges.schema["src"].dataType)
    state = trips.select("trip", "goal", F.col("origin").alias("node"), F.lit(0.0).alias("weight"), none.alias("parent"), F.lit(0).alias("round"))
    for r in itertools.count(1):
        arrived = state.where("node = goal").select("trip", F.col("weight").alias("most"))
        frontier = state.where(F.col("round") == r - 1).join(arrived, "trip", "left").where("node <> goal AND (most IS NULL OR weight < most)")
        steps = frontier.withColumnRenamed("weight", "so_far").join(edges, F.col("node") == F.col("src"))
        if barred is not None:
            steps = steps.join(barred, ["trip", "src", "dst"], "left_anti")
        steps = steps.select("trip", "goal", F.col("dst").alias("node"), (F.col("so_far") + F.col("weight")).alias("weight"), F.col("src").alias("parent"), F.lit(r).alias("round"))
        best = F.min(F.struct("weight", "parent", "round")).alias("b")
        state = kept(state.unionByName(steps).groupBy("trip", "goal", "node").agg(best).select("trip", "goal", "node", "b.*"))
        if state.where(F.col("round") == r).isEmpty():
            break
    return _traced(state, kept(state.where("node = goal")))


def alternatives(edges: DataFrame, trips: DataFrame, closed: DataFrame, most: int = 3) -> DataFrame:
    """(trip, goal, rank, weight, extra, path): up to ``most`` ways of each trip clear of the closed nodes.

    Each next way may not take the middle edge of those before it; ``extra`` is what it takes beyond the cheapest way
    that ignores closures, to a tenth.  A way of two nodes has no further alternative."""
    free = kept(without(edges, closed))
    base = cheapest(edges, trips).select("trip", F.col("weight").alias("base"))
    found, barred, live = [], None, trips
    for rank in range(1, most + 1):
        ways = kept(cheapest(free, live, barred).select("trip", "goal", F.lit(rank).alias("rank"), "weight", F.reverse("back").alias("path")))
        found.append(ways)
        at = F.floor(F.size("path") / 2).cast("int")
        middle = ways.where(F.size("path") > 2).select("trip", F.element_at("path", at + 1).alias("src"), F.element_at("path", at + 2).alias("dst"))
        barred = middle if barred is None else barred.unionByName(middle)
        live = trips.join(middle.select("trip"), "trip", "left_semi")
    out = found[0]
    for ways in found[1:]:
        out = out.unionByName(ways)
    extra = F.round(F.greatest(F.lit(0.0), F.col("weight") - F.coalesce("base", F.lit(10.0))), 1)
    return out.join(base, "trip", "left").select("trip", "goal", "rank", "weight", extra.alias("extra"), "path")


def step_minutes(metres: Column, arterial: Column) -> Column:
    """Minutes of one step of a way; ``metres`` is null where an end has no place."""
    return F.coalesce(F.greatest(F.lit(LEAST_STEP), metres / F.when(arterial, ARTERIAL).otherwise(LOCAL)), F.lit(UNPLACED_STEP))


def redundancy(nodes: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """(key, redundancy): share of arterial nodes that an event's blockage leaves open.

    ``nodes`` (node, class) are distinct; ``blocked`` (key, node, place) in order of place.  A blockage that begins on no
    arterial leaves three quarters, whatever else it blocks."""
    of = blocked.join(nodes, "node", "left")
    per = of.groupBy(key).agg(F.min_by(F.coalesce("class", F.lit("")), "place").alias("first"), F.count_distinct(F.when(F.col("class") == "arterial", F.col("node"))).alias("shut"))
    all_ = nodes.agg(F.count(F.when(F.col("class") == "arterial", 1)).alias("all"))  # one row
    left = F.when(F.col("first") != "arterial", 0.75).otherwise(F.round((F.col("all") - F.col("shut")) / F.col("all"), 4))
    return per.join(F.broadcast(all_)).select(key, left.alias("redundancy"))


#: Points that one task compares with each other, and the share of them that a hull must drop to be worth another round.
MOST_POINTS = 4096


def _unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    x, y = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], axis=1)


def hull(points: pd.DataFrame) -> pd.DataFrame:
    """The points (node, lon, lat) that can be the end of a longest distance: corners of their hull on the sphere, of equal
    places the two largest nodes.

    From any place the furthest point of a set within a hemisphere is a corner of its hull.  A gnomonic map makes great
    circles lines, so the hull is one of the plane; points within rounding of an edge are kept.  A set wider than that stays."""
    few = points.sort_values("node", ascending=False).groupby(["lon", "lat"], sort=False).head(2)
    places = few[["lon", "lat"]].drop_duplicates()
    unit = _unit(places["lon"].to_numpy(), places["lat"].to_numpy())
    middle = unit.mean(axis=0)
    middle /= max(np.linalg.norm(middle), 1e-300)
    ahead = unit @ middle
    if len(places) < 4 or ahead.min() < 0.1:
        return few
    side = np.cross(middle, [1.0, 0, 0] if abs(middle[0]) < 0.9 else [0, 1.0, 0])
    side /= np.linalg.norm(side)
    flat = np.stack([unit @ side, unit @ np.cross(middle, side)], axis=1) / ahead[:, None]
    slack = 1e-13 * max(1e-12, float(np.ptp(flat, axis=0).max()))
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    corners: set[int] = set()
    for way in (order, order[::-1]):
        chain: list[int] = []
        for k in way.tolist():
            while len(chain) > 1:
                (ax, ay), (bx, by), (cx, cy) = flat[chain[-2]], flat[chain[-1]], flat[k]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) >= -slack:
                    break
                chain.pop()
            chain.append(k)
        corners.update(chain)
    return few.merge(places.iloc[sorted(corners)], on=["lon", "lat"])


def furthest(points: pd.DataFrame) -> tuple[float, object, object] | None:
    """(metres, a, b) of the pair of nodes furthest apart, a < b; of equally far ones the largest (a, b)."""
    points = points.sort_values("node")
    node, lon, lat = (points[c].to_numpy() for c in ("node", "lon", "lat"))
    best = None
    for i in range(len(node) - 1):
        y1, y2 = np.radians(lat[i]), np.radians(lat[i + 1 :])
        a = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin(np.radians(lon[i + 1 :] - lon[i]) / 2) ** 2
        d = 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, a)))
        k = len(d) - 1 - int(d[::-1].argmax())  # the last of the longest
        if best is None or (d[k], node[i], node[i + 1 + k]) > best:
            best = (d[k], node[i], node[i + 1 + k])
    return best


def furthest_pairs(points: DataFrame) -> DataFrame:
    """(hub, a, b, dist_m): of each hub's points (hub, node, lon, lat) the two nodes furthest apart.

    No pairs are made of all points: groups of some MOST_POINTS leave their hulls, and so do these, until a hub's fit one
    task.  A hub of fewer than two points has none; points without a place do not count."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    points = kept(points.where("lon IS NOT NULL AND lat IS NOT NULL").select("hub", "node", "lon", "lat").distinct())
    before = None
    while True:
        per = points.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
        most, total = per.agg(F.max("n"), F.sum("n")).first()
        if most is None or most <= MOST_POINTS or (before is not None and total > 0.5 * before):
            break
        before = total
        dealt = points.join(per, "hub").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / MOST_POINTS)))
        points = kept(dealt.groupBy("hub", "part").applyInPandas(lambda g: hull(g)[["hub", "node", "lon", "lat"]], f"hub {kinds['hub']}, node {kinds['node']}, lon double, lat double"))

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        best = furthest(hull(group))
        return pd.DataFrame([(group["hub"].iloc[0], best[1], best[2], best[0])] if best else [], columns=["hub", "a", "b", "dist_m"])

    return points.groupBy("hub").applyInPandas(pair, f"hub {kinds['hub']}, a {kinds['node']}, b {kinds['node']}, dist_m double")


# fixed value: metres a second on the way round a closure
DETOUR_SPEED = 13.4


def corridor_detours(nodes: DataFrame, edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """(hub, a, b, available, nominal, extra, percent, seconds, way): for each blocked node the way between the two open
    neighbours furthest apart, as usual and clear of all blocked nodes, and whether there is one.

    ``nodes`` (node, lon, lat), ``edges`` (src, dst, weight) both ways, ``blocked`` (node).  All hubs' ways relax together.  The
    worst corridor is the first by available, extra downwards, hub.  A hub whose neighbours are not joined has no row only if
    it has fewer than two of them: through the hub there is always a way."""
    shut = blocked.select(F.col("node").alias("hub")).distinct()
    near = edges.join(shut, edges["src"] == shut["hub"]).select("hub", F.col("dst").alias("node")).distinct().join(blocked.select("node"), "node", "left_anti")
    pairs = kept(furthest_pairs(near.join(nodes.select("node", "lon", "lat"), "node")))
    trips = pairs.select(F.col("hub").alias("trip"), F.col("a").alias("origin"), F.col("b").alias("goal"))
    usual = cheapest(edges, trips).select(F.col("trip").alias("hub"), F.round("weight", 1).alias("nominal"))
    clear = cheapest(kept(without(edges, blocked)), trips).select(F.col("trip").alias("hub"), F.round("weight", 1).alias("around"), F.reverse("back").alias("way"))
    extra = F.round(F.greatest(F.lit(0.0), F.col("around") - F.col("nominal")), 1)
    both = pairs.join(usual, "hub").join(clear, "hub", "left").withColumn("extra", F.coalesce(extra, F.lit(0.0)))
    return both.select("hub", "a", "b", F.col("around").isNotNull().alias("available"), "nominal", "extra", F.round(F.col("extra") * 100 / F.greatest("nominal", F.lit(1.0)), 1).alias("percent"), F.round(F.col("extra") / DETOUR_SPEED, 1).alias("seconds"), "way")
