"""Claims of observations, reopened events, routes and what lies along them, and feeds read from files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims as cl, graph as gr, ordered as od, spatial as sp
from ..sources import feeds, readers as rd
from .graphs import EDGES_SQL, edges, nodes, seed
from .registry import Tables, query

#: The fixture's wording and types: the ledger's kinds as feeds, eight lines of text.
LINES = (
    "Crowd marching north on 5th, grew larger", "About 450 people gathered downtown", "Protesters dispersed at noon", "Vehicles moved 270 degrees off course",
    "Council meets on budget", "Group proceeding southeast slowly", "Lanes cleared", "March arrived with 1200 participants",
)
TYPES = {"error": "police_response", "click": "news_article", "purchase": "road_closure", "view": "transit_service_alert", "signup": "permit_event"}


def told(t: Tables) -> DataFrame:
    """Observations with types, headlines and payloads in the shape that feeds give them."""
    k = F.col("k")
    said = lambda when, value: F.when(when, value).cast("string")
    payload = {
        "call_type": said(k % 2 == 0, F.lit("Crowd")), "estimated_crowd": said(k % 3 == 0, k * 10), "units": said(k % 4 == 0, k), "route": said(k % 2 == 1, F.concat(F.lit("r"), (k % 3).cast("string"))),
        "expected_duration_min": k.cast("string"), "closure_type": said(k % 4 < 2, F.when(k % 4 == 0, "Full").otherwise("Reopened")), "street": F.concat(F.lit("s"), (k % 5).cast("string")),
        "reason": said(k % 6 == 0, F.lit("Special Event")), "alert_type": said(k % 5 == 0, F.lit("Service resumed")),
    }
    names = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    return t.obs.select(
        "observation_id", names[F.col("kind")].alias("observation_type"), F.element_at(F.array(*map(F.lit, LINES)), (k % len(LINES) + 1).cast("int")).alias("headline"),
        F.map_filter(F.create_map(*(x for n, v in payload.items() for x in (F.lit(n), v))), lambda _, v: v.isNotNull()).alias("payload"), F.when(k % 2 == 0, "official").otherwise("media").alias("authority"), F.lit(True).alias("official_source"),
    )


_TOLD = ", o AS (SELECT *, ([" + ", ".join(f"'{x}'" for x in LINES) + "])[k % 8 + 1] AS h, CASE WHEN k % 2 = 0 THEN 'confirmed' ELSE 'reported' END AS usual FROM obs)"
_ROWS = [  # kind, condition, predicate, value, unit, confidence, truth
    ("signup", "true", "'event.gathering'", "'true'", None, 1.0, "'confirmed'"), ("signup", "true", "'event.organized'", "'true'", None, 1.0, "'confirmed'"),
    ("signup", "true", "'event.route'", "CASE WHEN k % 2 = 1 THEN 'r' || k % 3 END", None, 1.0, "usual"), ("signup", "true", "'event.duration_expected'", "k::VARCHAR", "minutes", 1.0, "usual"),
    ("error", "true", "'police.response'", "CASE WHEN k % 2 = 0 THEN 'crowd' ELSE 'response' END", None, 1.0, "usual"), ("error", "true", "'event.gathering'", "'true'", None, 0.9, "usual"),
    ("error", "k % 3 = 0", "'event.estimated_crowd'", "(k * 10)::DOUBLE::VARCHAR", None, 0.6, "usual"), ("error", "k % 4 = 0", "'police.units'", "k::DOUBLE::VARCHAR", None, 1.0, "usual"),
    ("click", "true", "'event.gathering'", "'true'", None, 0.85, "usual"), ("click", "k % 8 IN (2, 6)", "'event.status'", "'dispersed'", None, 0.8, "usual"),
    ("click", "k % 8 IN (1, 7)", "'event.estimated_crowd'", "CASE k % 8 WHEN 1 THEN '450.0' ELSE '1200.0' END", None, 0.5, "usual"),
    *((kind, cond, pred, value, None, conf, "usual") for kind in ("error", "click") for cond, pred, value, conf in (
        ("k % 8 IN (0, 3, 5, 7)", "'event.movement'", "'true'", 0.8), ("k % 8 IN (0, 3, 5)", "'event.movement_direction'", "CASE k % 8 WHEN 0 THEN 'north' WHEN 3 THEN '270deg' ELSE 'southeast' END", 0.75), ("k % 8 IN (0, 1)", "'event.expansion'", "'true'", 0.7))),
    ("purchase", "true", "CASE WHEN k % 4 = 1 THEN 'road.reopened' ELSE 'road.closure' END", "'true'", None, 1.0, "'confirmed'"), ("purchase", "true", "'road.affected'", "'s' || k % 5", None, 1.0, "usual"),
    ("purchase", "k % 6 = 0", "'road.reason'", "'special event'", None, 1.0, "usual"), ("purchase", "k % 6 = 0", "'event.associated_disruption'", "'true'", None, 0.8, "usual"),
    ("view", "true", "'transit.status'", "CASE WHEN k % 5 = 0 THEN 'restored' ELSE 'disrupted' END", None, 1.0, "'confirmed'"), ("view", "k % 2 = 1", "'transit.affected'", "'r' || k % 3", None, 1.0, "usual"),
]
_CLAIMS = _TOLD + ", c AS (" + " UNION ALL ".join(
    f"SELECT observation_id, {pred} AS predicate, {value} AS value, {'NULL' if unit is None else repr(unit)}::VARCHAR AS unit, {conf}::DOUBLE AS confidence, {truth} AS truth FROM o WHERE kind = '{kind}' AND {cond}"
    for kind, cond, pred, value, unit, conf, truth in _ROWS) + ")"


@query(_CLAIMS + " SELECT observation_id, predicate, value, unit, confidence, truth FROM c", obs=True)
def claims_extracted(t: Tables) -> DataFrame:
    """What each observation claims, by the rules of its type and the wording of its text."""
    return cl.rule_claims(told(t))


@query(_CLAIMS + """, q AS (SELECT observation_id, 'event.estimated_crowd' AS predicate, regexp_extract(h, '([0-9]+)', 1)::DOUBLE::VARCHAR AS value, 'people' AS unit, 0.7::DOUBLE AS confidence, 'reported' AS truth FROM o WHERE k % 8 IN (1, 3, 7)),
u AS (SELECT *, 'rule' AS method, 0 AS r FROM c UNION ALL SELECT *, 'quantity', 1 FROM q)
SELECT observation_id, predicate, value, unit, confidence, truth, method FROM u QUALIFY row_number() OVER (PARTITION BY observation_id, predicate, value ORDER BY r, confidence, unit NULLS FIRST, truth) = 1""", obs=True)
def claims_union(t: Tables) -> DataFrame:
    """The rules' claims with those of a second extractor, which reads the first number of a text as a crowd."""
    rows, said = told(t), F.regexp_extract("headline", "([0-9]{3,})", 1)
    numbers = rows.where(said != "").select("observation_id", F.lit("event.estimated_crowd").alias("predicate"), said.cast("double").cast("string").alias("value"), F.lit("people").alias("unit"), F.lit(0.7).alias("confidence"), F.lit("reported").alias("truth"))
    return cl.union_claims(cl.rule_claims(rows).withColumn("method", F.lit("rule")), numbers.withColumn("method", F.lit("quantity")))


@query(_CLAIMS + """, s AS (SELECT observation_id // 100 AS place, predicate, value FROM c) SELECT a.place, count(*) AS conflicts FROM (SELECT DISTINCT place FROM s WHERE predicate = 'road.closure') a JOIN (SELECT DISTINCT place FROM s WHERE predicate = 'road.reopened') b USING (place) GROUP BY a.place""", obs=True)
def claim_conflicts(t: Tables) -> DataFrame:
    """Places about which some observation claims a closure and another that it is over."""
    c = cl.rule_claims(told(t)).select(F.floor(F.col("observation_id") / 100).alias("place"), F.lit("road").alias("about"), "predicate")
    found = sp.contradictions(c, "place", "about", "predicate", [("road.closure", "road.reopened")])
    return found.groupBy("place").agg(F.count(F.lit(1)).alias("conflicts"))


@query(""", g AS (SELECT source_id, observation_id, us, us - lag(us) OVER w AS gap, lag(k) OVER w AS before FROM obs WINDOW w AS (PARTITION BY source_id ORDER BY us, observation_id))
SELECT observation_id, source_id, CASE WHEN before >= 95 THEN 'new' ELSE 'reopened' END AS outcome FROM g WHERE gap > 86400000000""", obs=True)
def reopened_events(t: Tables) -> DataFrame:
    """Reports after an event closed: they reopen one that closed by silence; one closed for good stays closed."""
    return od.after_closure(t.obs, "source_id", "us", "observation_id", 86_400_000_000, F.col("k") >= 95).select("observation_id", "source_id", "outcome")


_DISTANCES = EDGES_SQL + """, w AS (SELECT 2::BIGINT AS node, 0.0::DOUBLE AS weight, [2::BIGINT] AS path UNION ALL SELECT e.dst, w.weight + e.weight, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.node WHERE NOT list_contains(w.path, e.dst)),
d AS (SELECT node, min(weight) AS weight FROM w GROUP BY node), parent AS (SELECT d.node, min(e.src) AS parent FROM d JOIN e ON e.dst = d.node JOIN d s ON s.node = e.src WHERE s.weight + e.weight = d.weight AND d.node <> 2 GROUP BY d.node),
r AS (SELECT node AS goal, node, 0::BIGINT AS back FROM d WHERE node < 25 UNION ALL SELECT r.goal, p.parent, r.back + 1 FROM r JOIN parent p ON p.node = r.node)"""


@query(_DISTANCES + " SELECT goal, node, back FROM r")
def route_paths(t: Tables) -> DataFrame:
    """The cheapest ways from one node to every nation, node by node from the goal back."""
    return gr.routes(edges(t), seed(t, 2), nodes(t).where("node < 25"))


def _file(t: Tables) -> str:
    return f"{gr.shared(t.spark)}/feed-{uuid.uuid4().hex}"


@query(""" SELECT 'q' || observation_id AS source_record_id, 'earthquake' AS observation_type, 'M ' || k || ' near <b>home</b>' AS said, us // 1000 * 1000 AS us, lon, lat, k::VARCHAR AS mag FROM obs""".replace("'M ' || k || ' near <b>home</b>' AS said", "'M ' || k || ' near home' AS headline"), obs=True)
def feed_earthquakes(t: Tables) -> DataFrame:
    """A GeoJSON feed written to files and read back through the feed's specification."""
    place = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    properties = F.struct(F.concat(F.lit("M "), "k", F.lit(" near <b>home</b>")).alias("title"), F.floor(F.col("us") / 1000).alias("time"), F.col("k").alias("mag"))
    path = _file(t)
    t.obs.select(F.to_json(F.struct(F.concat(F.lit("q"), "observation_id").alias("id"), properties.alias("properties"), place.alias("geometry"))).alias("value")).write.text(path)
    rows = feeds.observations(rd.json_lines(t.spark, path), "earthquakes", F.lit("2024-01-01").cast("timestamp"))
    return rows.select("source_record_id", "observation_type", "headline", F.unix_micros("event_time").alias("us"), "place.lon", "place.lat", F.col("payload")["mag"].alias("mag"))


@query(" SELECT 'r' || observation_id AS source_record_id, 'police_response' AS observation_type, CASE WHEN k % 7 > 0 THEN kind || ', petty' END AS headline, us // 86400000000 * 86400000000 AS us, lon, lat FROM obs", obs=True)
def feed_municipal_crime(t: Tables) -> DataFrame:
    """A city's CSV under its own column names, read through the common ones."""
    path = _file(t)
    day = F.date_format("event_time", "MM/dd/yyyy")
    said = F.when(F.col("k") % 7 > 0, F.concat("kind", F.lit(", petty"))).otherwise("N/A")
    t.obs.select(F.concat(F.lit("r"), "observation_id").alias("Report_Number"), day.alias("Date_Occ"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), said.alias("Offense")).write.option("header", True).csv(path)
    rows = feeds.observations(feeds.unify_dialects(rd.delimited(t.spark, path)), "municipal_crime", F.lit("2024-01-01").cast("timestamp"))
    return rows.select("source_record_id", "observation_type", "headline", F.unix_micros("event_time").alias("us"), "place.lon", "place.lat")
