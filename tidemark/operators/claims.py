"""Claims that observations make: rules over payloads and wording, as one array of conditional structs a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: compass words, in the order in which they are looked for
DIRECTIONS = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")
# fixed values: wording of movement, growth, dispersal and crowd sizes
MOVING = r"(?i)\b(moving|moved|marching|marched|advancing|proceeding|left|arrived)\b"
GROWING = r"(?i)\b(expand(ed|ing)|grew|spread|gathered|larger|bigger|more people)\b"
DISPERSED = r"(?i)\b(dispersed|departed|cleared)\b"
CROWD = r"(?i)([0-9]{3,6})\s+(?:people|protesters|participants)"

CLAIM = "predicate string, value string, unit string, confidence double, truth string"


def direction(text: Column) -> Column:
    """The first compass word of a text, else its degrees, else null."""
    named = [F.when(F.lower(text).rlike(rf"\b{d}(?:ward|wards)?\b"), d) for d in DIRECTIONS]
    degrees = F.regexp_extract(text, r"\b([0-9]{1,3})\s*degrees?\b", 1)
    return F.coalesce(*named, F.when(degrees != "", F.concat(degrees, F.lit("deg"))))


def rule_claims(observations: DataFrame) -> DataFrame:
    """(observation_id, CLAIM) from rows of observation_id, observation_type, headline, payload (a string map), authority
    and official_source.

    A claim whose field is missing keeps a null value where the rule states it always; numbers are written as doubles."""
    p, kind, head = F.col("payload"), F.col("observation_type"), F.coalesce("headline", F.lit(""))
    usual = F.when((F.col("authority") == "official") & F.col("official_source"), "confirmed").otherwise("reported")
    number = lambda name: p[name].try_cast("double").cast("string")
    has = lambda name: p[name].isNotNull() & (p[name] != "")

    def claim(when: Column, predicate: str | Column, value: Column, confidence: float = 1.0, confirmed: bool = False, unit: str | None = None) -> Column:
        name = F.lit(predicate) if isinstance(predicate, str) else predicate
        made = F.struct(name.alias("predicate"), value.cast("string").alias("value"), F.lit(unit).cast("string").alias("unit"), F.lit(confidence).alias("confidence"), (F.lit("confirmed") if confirmed else usual).alias("truth"))
        return F.when(when, made)

    of = lambda *kinds: kind.isin(*kinds)
    yes = F.lit("true")
    permit, police, news = of("permit_event"), of("police_response"), of("news_article")
    fire, road, transit = of("fire_dispatch"), of("road_closure", "road_construction"), of("transit_service_alert", "transit_delay")
    power, alarm, quake = of("power_outage", "water_outage"), of("official_emergency_notice", "severe_weather"), of("earthquake")
    prose = F.when(police, F.coalesce(F.when(has("detail"), p["detail"]), head)).otherwise(F.concat_ws(" ", head, p["body"]))
    told, moves = police | news, F.col("__prose").rlike(MOVING)
    closing = F.lower(F.coalesce(F.when(has("closure_type"), p["closure_type"]), p["element"], F.lit("")))
    alert = F.lower(F.coalesce(F.when(has("alert_type"), p["alert_type"]), p["status"], F.lit("")))
    way, size = direction(F.col("__prose")), F.regexp_extract("__prose", CROWD, 1)
    rules = [
        claim(permit, "event.gathering", yes, confirmed=True), claim(permit, "event.organized", yes, confirmed=True), claim(permit, "event.route", p["route"]),
        claim(permit, "event.duration_expected", p["expected_duration_min"], unit="minutes"), claim(permit & has("location"), "location.name", p["location"]),
        claim(police, "police.response", F.lower(F.coalesce(F.when(has("call_type"), p["call_type"]), F.lit("response")))), claim(police, "event.gathering", yes, 0.9),
        claim(police & has("estimated_crowd"), "event.estimated_crowd", number("estimated_crowd"), 0.6), claim(police & has("units"), "police.units", number("units")),
        claim(fire, "emergency.dispatch", F.lower(F.coalesce(F.when(has("incident_type"), p["incident_type"]), F.lit("response")))), claim(fire, "event.gathering", yes, 0.7),
        claim(news, "event.gathering", yes, 0.85),
        claim(told & moves, "event.movement", yes, 0.8), claim(told & moves & way.isNotNull(), "event.movement_direction", way, 0.75), claim(told & F.col("__prose").rlike(GROWING), "event.expansion", yes, 0.7),
        claim(news & F.col("__prose").rlike(DISPERSED), "event.status", F.lit("dispersed"), 0.8), claim(news & (size != ""), "event.estimated_crowd", size.try_cast("double"), 0.5),
        claim(road, F.when(closing.rlike("reopen|restored"), "road.reopened").otherwise("road.closure"), yes, confirmed=True), claim(road, "road.affected", F.coalesce(F.when(has("street"), p["street"]), p["location"])),
        claim(road & has("reason"), "road.reason", F.lower(p["reason"])), claim(road & has("severity"), "road.severity", F.lower(p["severity"])),
        claim(road & F.lower(p["reason"]).contains("special event"), "event.associated_disruption", yes, 0.8),
        claim(transit, "transit.status", F.when(alert.rlike("restored|resumed"), "restored").otherwise("disrupted"), confirmed=True), claim(transit & has("route"), "transit.affected", p["route"]),
        claim(transit & has("severity"), "transit.severity", F.lower(p["severity"])),
        claim(power, F.when(kind == "water_outage", "utility.water_outage").otherwise("utility.power_outage"), yes, confirmed=True), claim(power, "utility.customers_affected", p["customers_affected"]),
        claim(alarm, "emergency.official_guidance", F.coalesce(F.when(has("headline"), p["headline"]), F.when(has("event_name"), p["event_name"]), head), confirmed=True),
        claim(alarm, "hazard.severity", F.lower(F.coalesce(F.when(has("severity"), p["severity"]), F.lit("unknown")))), claim(alarm & has("instruction"), "emergency.instruction", p["instruction"]),
        claim(quake & p["magnitude"].isNotNull(), "hazard.magnitude", number("magnitude"), confirmed=True), claim(quake & p["depth_km"].isNotNull(), "hazard.depth", number("depth_km"), unit="km"),
        claim(quake & has("tsunami_flag"), "hazard.tsunami", yes, confirmed=True),
        claim(~(permit | police | news | fire | road | transit | power | alarm | quake), "location.name", F.when(head != "", head).otherwise(kind), 0.5),
    ]
    rows = observations.select("observation_id", "observation_type", "headline", "payload", "authority", "official_source", prose.alias("__prose"))
    return rows.select("observation_id", F.explode(F.array_compact(F.array(*rules))).alias("c")).select("observation_id", "c.*")


def union_claims(*extractors: DataFrame) -> DataFrame:
    """Claims of several extractors (observation_id, CLAIM, method), the first extractor's kept where predicate and value
    are the same; claims that differ in value all stay, so a conflict is not averaged away."""
    every = None
    for rank, claims in enumerate(extractors):
        part = claims.withColumn("rank", F.lit(rank))
        every = part if every is None else every.unionByName(part)
    rest = F.struct("rank", "confidence", "unit", "truth", "method")
    best = every.groupBy("observation_id", "predicate", "value").agg(F.min(rest).alias("c"))
    return best.select("observation_id", "predicate", "value", "c.unit", "c.confidence", "c.truth", "c.method")
