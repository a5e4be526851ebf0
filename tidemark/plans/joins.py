"""Joins: spatial and temporal candidates, deltas, exposure, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import shapes as sh
from ..operators import spatial as sp
from .registry import Tables, haversine_sql, query

#: Places that users care about: one for each supplier.
PLACES_SQL = ", places AS (SELECT s_suppkey AS place_id, CAST(-122.335 AS DOUBLE) + (s_suppkey % 97 - 48) * CAST(0.002 AS DOUBLE) AS lon, CAST(47.608 AS DOUBLE) + (s_nationkey - 12) * CAST(0.008 AS DOUBLE) AS lat, s_acctbal FROM supplier)"


def places(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.col("s_suppkey").alias("place_id"), (F.lit(-122.335) + (F.col("s_suppkey") % 97 - 48) * F.lit(0.002)).alias("lon"), (F.lit(47.608) + (F.col("s_nationkey") - 12) * F.lit(0.008)).alias("lat"), "s_acctbal"
    )


@query(f" SELECT observation_id, round({haversine_sql('lon', 'lat', '-122.335', '47.608')}, 3) AS dist_m, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 4) AS bearing FROM (SELECT *, degrees(atan2(sin(radians(lon + 122.335)) * cos(radians(lat)), cos(radians(47.608)) * sin(radians(lat)) - sin(radians(47.608)) * cos(radians(lat)) * cos(radians(lon + 122.335)))) AS d FROM obs)", obs=True)
def haversine_pairs(t: Tables) -> DataFrame:
    here = (F.lit(-122.335), F.lit(47.608))
    return t.obs.select("observation_id", F.round(geo.haversine_m(F.col("lon"), F.col("lat"), *here), 3).alias("dist_m"), F.round(geo.bearing_deg(*here, F.col("lon"), F.col("lat")), 4).alias("bearing"))


@query(" SELECT CAST(floor(lat * 111320.0 / 750) AS BIGINT) || ':' || CAST(floor(lon * 111320.0 * cos(radians(lat)) / 750) AS BIGINT) AS cell, count(*) AS n FROM obs GROUP BY ALL", obs=True)
def geo_cell(t: Tables) -> DataFrame:
    return t.obs.groupBy(geo.geo_cell(F.col("lon"), F.col("lat")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query(PLACES_SQL + f", pairs AS (SELECT place_id, observation_id, {haversine_sql('o.lon', 'o.lat', 'p.lon', 'p.lat')} AS d FROM places p, obs o) SELECT place_id, count(*) AS n, round(min(d), 3) AS nearest_m FROM pairs WHERE d <= 1200 GROUP BY place_id", obs=True)
def within_radius_join(t: Tables) -> DataFrame:
    """Observations near each place, counted by coordinates first, so no pair of a place and an observation is made."""
    at = t.obs.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n"))
    pairs = sp.within_distance(places(t).select("place_id", "lon", "lat"), at, 1200.0)
    return pairs.groupBy("place_id").agg(F.sum("n").alias("n"), F.round(F.min("dist_m"), 3).alias("nearest_m"))


@query(PLACES_SQL + f", pairs AS (SELECT observation_id, place_id, {haversine_sql('o.lon', 'o.lat', 'p.lon', 'p.lat')} AS d FROM places p, obs o) SELECT observation_id, place_id, round(d, 3) AS dist_m FROM pairs QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY d, place_id) = 1", obs=True)
def nearest_neighbour(t: Tables) -> DataFrame:
    """The nearest place of each observation, found once for each coordinate."""
    at = t.obs.groupBy("lon", "lat").agg(F.min("observation_id").alias("node"))
    got = sp.nearest(at, places(t).select("place_id", "lon", "lat"), "node", "place_id", 1500.0)
    found = at.join(got, "node").select("lon", "lat", "place_id", "dist_m")
    return t.obs.select("observation_id", "lon", "lat").join(found, ["lon", "lat"]).select("observation_id", "place_id", F.round("dist_m", 3).alias("dist_m"))


#: Events to resolve against: one a day and key, at its first report.
EVENTS_SQL = ", ev AS (SELECT event_key * 100 + us // 86400000000 % 100 AS event_id, min(us) AS us, arg_min(lon, us) AS lon, arg_min(lat, us) AS lat, arg_min(kind, us) AS kind FROM obs GROUP BY event_key, us // 86400000000)"
PAIRS_SQL = EVENTS_SQL + f""", pairs AS (SELECT o.observation_id, o.kind, e.kind AS ekind, e.event_id, abs(o.us - e.us) AS gap_us, {haversine_sql('o.lon', 'o.lat', 'e.lon', 'e.lat')} AS dist_m FROM obs o JOIN ev e ON abs(o.us - e.us) <= 10800000000), near AS (SELECT * FROM pairs WHERE dist_m <= 2500)"""


def day_events(t: Tables) -> DataFrame:
    day = F.floor(F.col("us") / 86_400_000_000).cast("long")
    first = F.min(F.struct("us", "lon", "lat", "kind")).alias("f")
    return t.obs.groupBy("event_key", day.alias("day")).agg(first).select((F.col("event_key") * 100 + F.col("day") % 100).alias("event_id"), "f.us", "f.lon", "f.lat", F.col("f.kind").alias("ekind"))


def near_pairs(t: Tables) -> DataFrame:
    o = t.obs.select("observation_id", "us", "lon", "lat", "kind")
    return sp.candidates(o, day_events(t), 10_800_000_000, 2500.0)


@query(PAIRS_SQL + " SELECT observation_id, event_id, gap_us, round(dist_m, 3) AS dist_m FROM near", obs=True)
def resolver_candidates(t: Tables) -> DataFrame:
    return near_pairs(t).select("observation_id", "event_id", "gap_us", F.round("dist_m", 3).alias("dist_m"))


@query(PAIRS_SQL + """, s AS (SELECT *, greatest(0.0, 1 - dist_m / 2500) AS sp, greatest(0.0, 1 - gap_us / 1e6 / 10800) AS tm, CASE WHEN kind = ekind THEN 0.6 ELSE 0.2 END AS ty FROM near),
r AS (SELECT observation_id, event_id, round(CAST(sp * 0.30 + tm * 0.20 + ty * 0.15 + 0.5 * 0.08 + 0.15 * 0.12 AS DOUBLE), 6) AS score, (sp >= 0.8 AND tm >= 0.7 AND ty >= 0.4) AS ok FROM s), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY score DESC, event_id) = 1)
SELECT observation_id, event_id, score, CASE WHEN score >= 0.55 AND ok THEN 'match' WHEN score >= 0.45 THEN 'possible' ELSE 'new' END AS decision FROM b""", obs=True)
def resolver_decision(t: Tables) -> DataFrame:
    space, time = F.greatest(F.lit(0.0), 1 - F.col("dist_m") / 2500), F.greatest(F.lit(0.0), 1 - F.col("gap_us") / 1e6 / 10800)
    kind = F.when(F.col("kind") == F.col("ekind"), 0.6).otherwise(0.2)
    s = near_pairs(t).select("observation_id", "event_id", F.round(sp.match_score(space, time, kind, F.lit(0.0), F.lit(0.15), F.lit(0.5)), 6).alias("score"), ((space >= 0.8) & (time >= 0.7) & (kind >= 0.4)).alias("corroborated"))
    return sp.decide(s, "observation_id", "score", "event_id", F.col("corroborated"), merge=0.55)


CONFLICTS = [("error", "signup"), ("view", "purchase")]


@query(""", c AS (SELECT DISTINCT source_id AS subject, k AS predicate, kind AS v FROM obs) SELECT a.subject, a.predicate, a.v AS first, b.v AS second FROM c a JOIN c b USING (subject, predicate) WHERE (a.v, b.v) IN (('error', 'signup'), ('view', 'purchase'))""", obs=True)
def contradictions(t: Tables) -> DataFrame:
    claims = t.obs.select(F.col("source_id").alias("subject"), F.col("k").alias("predicate"), "kind")
    return sp.contradictions(claims, "subject", "predicate", "kind", CONFLICTS)


_DELTA = """, p AS (SELECT event_key, k, max(value) AS v FROM obs WHERE us < 1705363200000000 GROUP BY ALL), c AS (SELECT event_key, k, max(value) AS v FROM obs WHERE us >= 1705363200000000 GROUP BY ALL)"""


def two_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    cut = F.col("us") < 1_705_363_200_000_000
    side = lambda w, name: t.obs.where(w).groupBy("event_key", "k").agg(F.max("value").alias(name))
    return side(cut, "before"), side(~cut, "after")


@query(_DELTA + " SELECT event_key, k, p.v AS before, c.v AS after, CASE WHEN p.v IS NULL THEN 'appeared' WHEN c.v IS NULL THEN 'resolved' WHEN c.v > p.v THEN 'escalated' WHEN c.v < p.v THEN 'eased' ELSE 'same' END AS change FROM p FULL JOIN c USING (event_key, k)", obs=True)
def delta_full_outer(t: Tables) -> DataFrame:
    before, after = two_sides(t)
    change = F.when(F.col("before").isNull(), "appeared").when(F.col("after").isNull(), "resolved").when(F.col("after") > F.col("before"), "escalated").when(F.col("after") < F.col("before"), "eased").otherwise("same")
    return before.join(after, ["event_key", "k"], "full_outer").select("event_key", "k", "before", "after", change.alias("change"))


@query(_DELTA + " SELECT event_key, k, round((c.v - p.v) / abs(p.v), 6) AS relative, round(least(1.0, abs((c.v - p.v) / p.v)), 6) AS magnitude FROM p JOIN c USING (event_key, k) WHERE abs(p.v) > 0 AND abs((c.v - p.v) / p.v) > 0.05", obs=True)
def magnitude_deltas(t: Tables) -> DataFrame:
    before, after = two_sides(t)
    rel = (F.col("after") - F.col("before")) / F.abs("before")
    both = before.join(after, ["event_key", "k"]).where((F.abs("before") > 0) & (F.abs(rel) > 0.05))
    return both.select("event_key", "k", F.round(rel, 6).alias("relative"), F.round(F.least(F.lit(1.0), F.abs(rel)), 6).alias("magnitude"))


@query(_DELTA + """, d AS (SELECT event_key, CASE WHEN p.v IS NULL THEN 'appeared' WHEN c.v IS NULL THEN 'resolved' ELSE 'moved' END AS verb, least(4, CAST(floor(coalesce(c.v, p.v) / 60) AS BIGINT)) AS sev FROM p FULL JOIN c USING (event_key, k))
SELECT event_key, verb, count(*) AS n, max(sev) AS peak, round(0.7 * max(sev) / 4 + 0.3 * least(1.0, count(*) / 5.0), 6) AS magnitude FROM d GROUP BY ALL HAVING 0.7 * max(sev) / 4 + 0.3 * least(1.0, count(*) / 5.0) >= 0.12""", obs=True)
def material_feed(t: Tables) -> DataFrame:
    """Appeared, resolved and moved impacts of each event above the material floor."""
    before, after = two_sides(t)
    verb = F.when(F.col("before").isNull(), "appeared").when(F.col("after").isNull(), "resolved").otherwise("moved")
    sev = F.least(F.lit(4), F.floor(F.coalesce("after", "before") / 60).cast("long"))
    per = before.join(after, ["event_key", "k"], "full_outer").groupBy("event_key", verb.alias("verb")).agg(F.count(F.lit(1)).alias("n"), F.max(sev).alias("peak"))
    m = F.col("peak") * 0.7 / 4 + F.least(F.lit(1.0), F.col("n") / 5.0) * 0.3
    return per.where(m >= 0.12).select("event_key", "verb", "n", "peak", F.round(m, 6).alias("magnitude"))


@query(""", r AS (SELECT event_key, k, max(value) AS v, count(*) AS n FROM obs WHERE kind = 'error' GROUP BY ALL), i AS (SELECT event_key, k, max(value) AS v, count(*) AS n FROM obs WHERE kind <> 'error' GROUP BY ALL)
SELECT event_key, k, coalesce(r.v, i.v) AS severity, CASE WHEN r.v IS NOT NULL THEN 'reported' ELSE 'inferred' END AS truth, coalesce(r.n, 0) + coalesce(i.n, 0) AS evidence FROM r FULL JOIN i USING (event_key, k)""", obs=True)
def impact_merge(t: Tables) -> DataFrame:
    side = lambda which, v, n: t.obs.where(which).groupBy("event_key", "k").agg(F.max("value").alias(v), F.count(F.lit(1)).alias(n))
    both = side(F.col("kind") == "error", "rv", "rn").join(side(F.col("kind") != "error", "iv", "n"), ["event_key", "k"], "full_outer")
    return both.select("event_key", "k", F.coalesce("rv", "iv").alias("severity"), F.when(F.col("rv").isNotNull(), "reported").otherwise("inferred").alias("truth"), (F.coalesce("rn", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("evidence"))


@query(PLACES_SQL + f""", i AS (SELECT event_key, avg(lon) AS lon, avg(lat) AS lat, least(1.0, max(value) / 400) AS severity FROM obs GROUP BY event_key), d AS (SELECT place_id, event_key, severity, {haversine_sql('i.lon', 'i.lat', 'p.lon', 'p.lat')} AS d FROM places p, i)
SELECT place_id, count(*) AS events, round(max(least(1.0, (1 - d / 10000) * (0.5 * severity + 0.3))), 5) AS exposure, round(min(d), 1) AS nearest_m FROM d WHERE d <= 10000 GROUP BY place_id""", obs=True)
def exposure_score(t: Tables) -> DataFrame:
    """Exposure of places to event centres within 10 km, by proximity and severity."""
    i = t.obs.groupBy("event_key").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.least(F.lit(1.0), F.max("value") / 400).alias("severity"))
    near = sp.within_distance(places(t).select("place_id", "lon", "lat"), i, 10_000.0)
    score = F.least(F.lit(1.0), (1 - F.col("dist_m") / 10000) * (F.col("severity") * 0.5 + 0.3))
    return near.groupBy("place_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.max(score), 5).alias("exposure"), F.round(F.min("dist_m"), 1).alias("nearest_m"))


@query(" SELECT source_id FROM obs WHERE kind = 'error' UNION SELECT source_id FROM obs WHERE k > 95 EXCEPT SELECT source_id FROM obs WHERE value > 300 AND kind = 'view'", obs=True)
def union_reachable(t: Tables) -> DataFrame:
    """Active or recoverable sources, those closed for good left out: one pass of flags instead of three scans."""
    per = t.obs.groupBy("source_id").agg(F.bool_or((F.col("kind") == "error") | (F.col("k") > 95)).alias("open"), F.bool_or((F.col("value") > 300) & (F.col("kind") == "view")).alias("shut"))
    return per.where(F.col("open") & ~F.col("shut")).select("source_id")


@query(", s AS (SELECT event_key, list_sort(list(DISTINCT k) FILTER (us < 1705363200000000)) AS a, list_sort(list(DISTINCT k) FILTER (us >= 1705363200000000)) AS b FROM obs GROUP BY event_key) SELECT event_key, len(list_intersect(a, b)) AS both, len(list_distinct(list_concat(a, b))) AS either, len(b) - len(list_intersect(a, b)) AS fresh FROM s", obs=True)
def evidence_sets(t: Tables) -> DataFrame:
    cut = F.col("us") < 1_705_363_200_000_000
    s = t.obs.groupBy("event_key").agg(F.collect_set(F.when(cut, F.col("k"))).alias("a"), F.collect_set(F.when(~cut, F.col("k"))).alias("b"))
    n = lambda c, name: F.size(c).cast("long").alias(name)
    return s.select("event_key", n(F.array_intersect("a", "b"), "both"), n(F.array_union("a", "b"), "either"), n(F.array_except("b", "a"), "fresh"))


#: An area in the shape of an L around the centre, and the two boxes that make it up.
AREA = '{"type":"Polygon","coordinates":[[[-122.36,47.58],[-122.31,47.58],[-122.31,47.60],[-122.34,47.60],[-122.34,47.64],[-122.36,47.64],[-122.36,47.58]]]}'


_IN_L = """(lon {o} -122.36 {p} 1e-6 AND lon {c} -122.31 {m} 1e-6 AND lat {o} 47.58 {p} 1e-6 AND lat {c} 47.60 {m} 1e-6) OR (lon {o} -122.36 {p} 1e-6 AND lon {c} -122.34 {m} 1e-6 AND lat {o} 47.58 {p} 1e-6 AND lat {c} 47.64 {m} 1e-6)"""
#: Cells of the area's cover, in degrees.
_AREA_STEP = 0.01


def _in_area(t: Tables, edge: bool) -> DataFrame:
    area = t.spark.range(1).select(F.col("id").alias("area_id"), F.lit(AREA).alias("geometry"))
    cover = sh.cover(area, "area_id", "geometry", _AREA_STEP)
    return sh.points_in(t.obs.select("observation_id", "lon", "lat"), "observation_id", cover, "area_id", _AREA_STEP, edge).select("observation_id")


@query(" SELECT observation_id FROM obs WHERE " + _IN_L.format(o=">", c="<", p="+", m="-"), obs=True)
def polygon_contains(t: Tables) -> DataFrame:
    """Observations inside a polygon, off its edge."""
    return _in_area(t, False)


@query(" SELECT observation_id FROM obs WHERE " + _IN_L.format(o=">=", c="<=", p="-", m="+"), obs=True)
def polygon_covers(t: Tables) -> DataFrame:
    """Observations in a polygon or on its edge."""
    return _in_area(t, True)
