"""Guards of content, derivations of feeds, alternatives of routes and crossings of ways with areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, guards as gd, text as tx
from ..operators import ordered as od, routing as ro, spatial as sp
from .graphs import EDGES_SQL, edges, nodes, seed
from .joins import PLACES_SQL, places
from .registry import Tables, haversine_sql, query

#: The fixture's wording with the reason, if any, for which it must be withheld.
SAID = (
    ("Evacuate the area at once", "independent_evacuation_directive"), ("Crowd is moving north", None), ("Official guidance is outdated", "overrides_official_guidance"),
    ("Highway 520 has been shut", "authoritative_road_closure"), ("The street fair opens at ten", None), ("There are 1,200 protesters downtown", "unsourced_current_fact"),
    ("These activists are violent", "assigns_criminal_intent"), ("Delays on the bridge", None), ("Please proceed to the nearest shelter", "independent_evacuation_directive"), ("route 7 remains closed", "authoritative_road_closure"),
)


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


_TEXTS = "[" + ", ".join(f"'{s}'" for s, _ in SAID) + "]"
_REASONS = "[" + ", ".join("NULL" if r is None else f"'{r}'" for _, r in SAID) + "]"


@query(f", s AS (SELECT observation_id, {_TEXTS}[k % 10 + 1] AS said, {_REASONS}[k % 10 + 1] AS reason FROM obs) SELECT observation_id, CASE WHEN reason IS NULL THEN said END AS kept, reason, CASE WHEN reason IS NULL THEN 'note,predicate' ELSE 'predicate' END AS fields FROM s", obs=True)
def content_guard(t: Tables) -> DataFrame:
    """Texts with the reason for which they are withheld, and the fields of a record that may stay."""
    said = _pick([s for s, _ in SAID], F.col("k") % len(SAID))
    rows = t.obs.select("observation_id", said.alias("said"), F.create_map(F.lit("predicate"), F.lit("emergency.evacuation"), F.lit("note"), said).alias("record"))
    reason, left = gd.prohibited(F.col("said")), F.array_join(F.sort_array(F.map_keys(gd.kept_fields(F.col("record")))), ",")
    return rows.select("observation_id", F.when(reason.isNull(), F.col("said")).alias("kept"), reason.alias("reason"), left.alias("fields"))


@query(" SELECT observation_id, CASE k % 4 WHEN 0 THEN 'show_banner' WHEN 1 THEN 'Navigate_To' WHEN 2 THEN 'open_modal' END AS directive FROM obs", obs=True)
def screen_guard(t: Tables) -> DataFrame:
    """Items' directives to a screen: in the wording, in the ``screen`` field, in a field's name, or none."""
    k = F.col("k") % 4
    payload = F.map_filter(F.create_map(F.lit("screen"), F.when(k == 1, "Navigate_To"), F.lit("open_modal"), F.when(k == 2, "x"), F.lit("note"), F.lit("slideshow_7")), lambda _, v: v.isNotNull())
    rows = t.obs.select("observation_id", F.when(k == 0, "Please show_banner now").otherwise("Road reopened").alias("headline"), payload.alias("payload"))
    return rows.select("observation_id", gd.directive(F.col("headline"), F.lit(None).cast("string"), F.col("payload")).alias("directive"))


@query(" SELECT observation_id, k % 6 < 4 AS us FROM obs", obs=True)
def united_states(t: Tables) -> DataFrame:
    country = _pick((" USA ", "United States of America", "840.0", "u.s.", "Sudan", "84"), F.col("k") % 6)
    return t.obs.select("observation_id", tx.is_united_states(country, F.lit(None).cast("string")).alias("us"))


@query(" SELECT observation_id, CASE k % 4 WHEN 0 THEN k || '|36|44-45' WHEN 1 THEN '7C' END AS routes FROM obs", obs=True)
def transit_routes(t: Tables) -> DataFrame:
    """Route numbers that an alert's wording lists."""
    k = F.col("k")
    said = F.when(k % 4 == 0, F.concat(F.lit("Detour. Affected routes: "), k, F.lit(", 36, 44-45 until noon"))).when(k % 4 == 1, "affected route 7C\n").when(k % 4 == 2, "Affected routes: none").otherwise("Service resumed")
    return t.obs.select("observation_id", F.array_join(tx.affected_routes(said), "|").alias("routes"))


@query(" SELECT observation_id, CASE WHEN k % 4 < 3 THEN value END AS reading FROM obs", obs=True)
def station_readings(t: Tables) -> DataFrame:
    """Readings of weather stations whose quality flag lets them stand."""
    flag = F.when(F.col("k") % 4 == 1, "V").when(F.col("k") % 4 == 2, "C").when(F.col("k") % 4 == 3, "Q")
    return t.obs.select("observation_id", tx.checked_reading(F.col("value"), flag).alias("reading"))


@query(" SELECT observation_id, 'employment county 53' || lpad(k::VARCHAR, 3, '0') || ' 2020-' || lpad((k % 12 + 1)::VARCHAR, 2, '0') || 'w' || (k % 4 + 1) || ': ' || CASE WHEN k % 5 = 0 THEN 'emp_ss40' ELSE 'emp' END || '=' || printf('%+.3f', k / 100.0 - 0.5) AS headline FROM obs WHERE k % 3 = 0", obs=True)
def county_activity(t: Tables) -> DataFrame:
    """County rows of one state, named by the first series that has a value."""
    k, value = F.col("k"), F.col("k") / 100.0 - 0.5
    rows = t.obs.select("observation_id", k, F.concat(F.when(k % 3 == 0, "53").otherwise("1"), F.lpad(k.cast("string"), 3, "0")).alias("countyfips"), F.when(k % 5 > 0, value).alias("emp"), value.alias("emp_ss40"))
    first = F.coalesce(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.format_string("%+.3f", c))) for c in ("emp", "emp_ss40")))
    here = rows.where(tx.cell_key(F.col("countyfips")).startswith("53")).where(first.isNotNull())
    return here.select("observation_id", F.concat(F.lit("employment county "), "countyfips", F.format_string(" 2020-%02dw%d: ", k % 12 + 1, k % 4 + 1), first).alias("headline"))


@query(PLACES_SQL + " SELECT observation_id, p.lon AS city_lon, p.lat AS city_lat FROM obs o LEFT JOIN places p ON p.place_id = o.source_id", obs=True)
def city_places(t: Tables) -> DataFrame:
    """Rows that know only a city's id get its coordinates, null where the table of cities lacks it."""
    cities = places(t).select(F.col("place_id").alias("source_id"), F.col("lon").alias("city_lon"), F.col("lat").alias("city_lat"))
    return t.obs.select("observation_id", "source_id").join(cities, "source_id", "left").select("observation_id", "city_lon", "city_lat")


@query(", p AS (SELECT observation_id, k / 100.0 AS p FROM obs) SELECT observation_id, round(greatest(0.0, p - 0.14), 4) AS low, round(least(1.0, p + 0.14), 4) AS high, round(4.0 * p * (1.0 - p), 4) AS width FROM p", obs=True)
def forecast_intervals(t: Tables) -> DataFrame:
    """Bounds round a probability, and its uncertainty, widest at one half."""
    p = F.col("k") / 100.0
    return t.obs.select("observation_id", F.round(F.greatest(F.lit(0.0), p - 0.14), 4).alias("low"), F.round(F.least(F.lit(1.0), p + 0.14), 4).alias("high"), F.round(p * 4.0 * (1.0 - p), 4).alias("width"))


_TAKES = "list_contains(w.path, r.a) AND list_contains(w.path, r.b) AND list_position(w.path, r.b) = list_position(w.path, r.a) + 1"
_MIDDLE = "w.path[len(w.path) // 2 + 1] AS a, w.path[len(w.path) // 2 + 2] AS b"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY w.node ORDER BY w.weight, list_reverse(w.path)) = 1"


@query(EDGES_SQL + f""", w AS (SELECT 2::BIGINT AS node, 0.0::DOUBLE AS weight, [2::BIGINT] AS path UNION ALL SELECT e.dst, w.weight + e.weight, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.node WHERE NOT list_contains(w.path, e.dst)),
base AS (SELECT node, min(weight) AS base FROM w GROUP BY node), f AS (SELECT * FROM w WHERE node < 25 AND node <> 2 AND NOT list_contains(path, 4)), one AS (SELECT w.*, {_MIDDLE} FROM f w {_FIRST}),
two AS (SELECT w.*, {_MIDDLE} FROM f w JOIN one r ON r.node = w.node AND len(r.path) > 2 AND NOT ({_TAKES}) {_FIRST}),
three AS (SELECT w.* FROM f w JOIN two r ON r.node = w.node AND len(r.path) > 2 AND NOT ({_TAKES}) JOIN one q ON q.node = w.node AND NOT ({_TAKES.replace('r.', 'q.')}) {_FIRST}),
every AS (SELECT node, 1 AS rank, weight, path FROM one UNION ALL SELECT node, 2, weight, path FROM two UNION ALL SELECT node, 3, weight, path FROM three)
SELECT node AS goal, rank, weight, round(greatest(0.0, weight - base), 1) AS extra, array_to_string(path, '>') AS way FROM every JOIN base USING (node)""")
def route_alternatives(t: Tables) -> DataFrame:
    """Up to three ways from one node to every nation clear of a closed node, with what each takes beyond the usual way."""
    trips = nodes(t).where("node < 25 AND node <> 2").select(F.col("node").alias("trip"), F.lit(2).cast("long").alias("origin"), F.col("node").alias("goal"))
    return ro.alternatives(edges(t), trips, seed(t, 4)).select("goal", "rank", "weight", "extra", F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("way"))


@query(f""", s AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lag(k) OVER w AS k0 FROM obs WINDOW w AS (PARTITION BY source_id ORDER BY us, observation_id)),
m AS (SELECT source_id, lon0, greatest(0.5, {haversine_sql('lon0', 'lat0', 'lon', 'lat')} / CASE WHEN k % 2 = 0 OR k0 % 2 = 0 THEN 550.0 ELSE 350.0 END) AS minutes FROM s) SELECT source_id, round(coalesce(sum(minutes) FILTER (lon0 IS NOT NULL), 1.0), 1) AS minutes FROM m GROUP BY source_id""", obs=True)
def travel_times(t: Tables) -> DataFrame:
    """Minutes along each source's reports in order; a source of one report counts as one minute."""
    names = ("lon", "lat", "k")
    s = od.lagged(t.obs.select("source_id", "us", "observation_id", *names), ["source_id"], ["us", "observation_id"], names)
    s = s.withColumns({f"{c}0": F.col("__before")[c] for c in names})
    step = ro.step_minutes(geo.haversine_m(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")), (F.col("k") % 2 == 0) | (F.col("k0") % 2 == 0))
    return s.groupBy("source_id").agg(F.round(F.coalesce(F.sum(F.when(F.col("lon0").isNotNull(), step)), F.lit(1.0)), 1).alias("minutes"))


@query(""", b AS (SELECT event_key, us, observation_id, k + 1 AS node FROM obs WHERE kind = 'error'), n AS (SELECT s_suppkey AS node, s_suppkey % 3 = 0 AS arterial FROM supplier),
p AS (SELECT event_key, arg_min(coalesce(arterial, false), (us, observation_id)) AS first, count(DISTINCT CASE WHEN arterial THEN node END) AS shut FROM b LEFT JOIN n USING (node) GROUP BY event_key)
SELECT event_key, CASE WHEN NOT first THEN 0.75 ELSE round(((SELECT count(*) FROM n WHERE arterial) - shut) / (SELECT count(*) FROM n WHERE arterial), 4) END::DOUBLE AS redundancy FROM p""", obs=True)
def network_redundancy(t: Tables) -> DataFrame:
    """Share of arterial nodes that each event's blockages leave open (blockages are the reports of kind ``error``)."""
    network = t.supplier.select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 3 == 0, "arterial").otherwise("local").alias("class"))
    blocked = t.obs.where("kind = 'error'").select("event_key", (F.col("k") + 1).alias("node"), F.struct("us", "observation_id").alias("place"))
    return ro.redundancy(network, blocked, "event_key")


_SIDE = lambda ax, ay, bx, by, px, py: f"(({bx}) - ({ax})) * (({py}) - ({ay})) - (({by}) - ({ay})) * (({px}) - ({ax}))"


@query(PLACES_SQL + """, c AS (SELECT n_nationkey AS area_id, CAST(-122.335 AS DOUBLE) + (n_nationkey - 12) * CAST(0.006 AS DOUBLE) AS x, CAST(47.608 AS DOUBLE) + (n_nationkey % 5 - 2) * CAST(0.02 AS DOUBLE) AS y FROM nation), r AS (SELECT CAST(0.0071 AS DOUBLE) AS h),
g AS (SELECT area_id, x - h AS x1, y - h AS y1, x + h AS x2, y - h AS y2 FROM c, r UNION ALL SELECT area_id, x + h, y - h, x + h, y + h FROM c, r UNION ALL SELECT area_id, x + h, y + h, x - h, y + h FROM c, r UNION ALL SELECT area_id, x - h, y + h, x - h, y - h FROM c, r),
m AS (SELECT DISTINCT area_id, place_id FROM g, places WHERE greatest(least(x1, x2), least(lon, -122.335)) <= least(greatest(x1, x2), greatest(lon, -122.335)) AND greatest(least(y1, y2), least(lat, 47.608)) <= least(greatest(y1, y2), greatest(lat, 47.608))
 AND sign(""" + _SIDE("x1", "y1", "x2", "y2", "lon", "lat") + ") * sign(" + _SIDE("x1", "y1", "x2", "y2", "-122.335::DOUBLE", "47.608::DOUBLE") + ") <= 0 AND sign(" + _SIDE("lon", "lat", "-122.335::DOUBLE", "47.608::DOUBLE", "x1", "y1") + ") * sign(" + _SIDE("lon", "lat", "-122.335::DOUBLE", "47.608::DOUBLE", "x2", "y2") + """) <= 0)
SELECT area_id, count(*) AS ways FROM m GROUP BY area_id""", obs=True)
def ways_across_areas(t: Tables) -> DataFrame:
    """How many of the places' ways to the centre meet the edge of each area."""
    x, y, h = F.lit(-122.335) + (F.col("n_nationkey") - 12) * F.lit(0.006), F.lit(47.608) + (F.col("n_nationkey") % 5 - 2) * F.lit(0.02), F.lit(0.0071)
    corners = [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]
    sides = F.array(*(F.struct(a[0].alias("lon1"), a[1].alias("lat1"), b[0].alias("lon2"), b[1].alias("lat2")) for a, b in zip(corners, corners[1:] + corners[:1])))
    areas = t.nation.select(F.col("n_nationkey").alias("area_id"), F.explode(sides).alias("s")).select("area_id", "s.*")
    ways = places(t).select("place_id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.lit(-122.335).alias("lon2"), F.lit(47.608).alias("lat2"))
    return sp.meeting(ways, areas, "place_id", "area_id").distinct().groupBy("area_id").agg(F.count(F.lit(1)).alias("ways"))
