"""Feeds as declarative specifications, and the one projection that turns any of them into observations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import readers as rd


class Feed(NamedTuple):
    """Where a feed's records are and what they mean.

    ``kinds`` are the observation types it can emit, the first being the default; ``retype`` gives words that turn the
    default into another one; ``payload`` maps names to input fields.  ``observed`` are the times at which a record was made
    known, where they differ from its event's; a year beyond ``last_year`` is a publisher's slip for ``slip_year``."""

    kinds: tuple[str, ...]
    ids: tuple[str, ...]
    headline: tuple[str, ...]
    times: tuple[str, ...]
    payload: tuple[str, ...] = ()
    authority: str = "official"
    domain: str = "safety"
    shape: str = "json"
    retype: tuple[tuple[str, tuple[str, ...]], ...] = ()
    keep: str | None = None
    observed: tuple[str, ...] = ()
    last_year: int | None = None
    slip_year: int = 2024


# fixed values: the fields of each feed, named as the publishers name them
FEEDS: dict[str, Feed] = {
    "police_cad": Feed(("police_response",), ("cad_event_number",), ("initial_call_type", "final_call_type", "call_type"), ("cad_event_original_time_queued",), ("priority", "event_group", "dispatch_precinct", "dispatch_beat", "dispatch_address", "cad_event_clearance_description")),
    "police_blotter": Feed(("news_article",), ("guid", "link"), ("title",), ("pub_date", "published"), ("description", "categories"), domain="news"),
    "fire_dispatch": Feed(("fire_dispatch",), ("incident_number",), ("type",), ("datetime",), ("address",)),
    "event_permits": Feed(("permit_event",), ("permit_number", "name_of_event"), ("name_of_event",), ("event_start_date", "start_date", "application_date"), ("permit_type", "permit_status", "organization", "attendance", "event_location_neighborhood", "event_end_date"), domain="events"),
    "news": Feed(("news_article", "police_response", "road_closure", "fire_dispatch", "severe_weather"), ("guid", "link"), ("title",), ("pub_date", "published"), ("description", "categories"), "media", "news",
                 retype=(("fire_dispatch", ("fire", "blaze")), ("police_response", ("shooting", "police", "assault", "robbery")), ("road_closure", ("closure", "closed", "crash", "collision")), ("severe_weather", ("storm", "flood", "wind", "snow")))),
    "street_use": Feed(("road_construction", "road_closure"), ("permit_number",), ("project_name", "project_description"), ("start_date",), ("permit_type", "street_on", "street_from", "street_to", "end_date"), domain="road", retype=(("road_closure", ("closure", "closed", "block party", "street event")),), observed=("issue_date", "created_date", "application_date"), last_year=2050),
    "road_alerts": Feed(("traffic_condition", "road_closure"), ("OBJECTID",), ("HeadlineMessage",), ("LastModifiedDate",), ("Road", "RoadDirection", "EventCategoryDescription", "RoadClosedFlag"), domain="road", retype=(("road_closure", ("closed", "closure", "blocked")),)),
    "cameras": Feed(("camera_imagery",), ("Id",), ("Description",), (), ("ImageUrl", "Type"), domain="traffic"),
    "drawbridges": Feed(("bridge_restriction",), ("entityid",), ("entityname",), ("opendatetime",), ("entitytype", "closedatetime", "minutesopen"), domain="road"),
    "mountain_passes": Feed(("traffic_condition",), ("PassName",), ("PassName",), ("DisplayDate",), ("Elevation", "Weather", "RoadCondition"), domain="road"),
    "bridge_clearances": Feed(("bridge_restriction",), ("Crossing_GUID",), ("Title", "Route_Location"), (), ("State_Route_Identifier", "Minimum_Vertical_Clearance", "Minimum_Vertical_Clearance_Inches", "Direction"), domain="road"),
    "work_zones": Feed(("road_construction",), ("WorkZoneId",), ("LaneClosureDescription", "Landmark"), ("StartDate",), ("EndDate", "StateRouteId", "WorkZoneType", "PriorityDescription"), domain="road"),
    "transit_vehicles": Feed(("vehicle_position",), ("vehicleId",), ("tripId",), ("lastUpdateTime",), ("tripId", "scheduleDeviation", "phase", "status", "occupancyStatus"), domain="transit"),
    "transit_alerts": Feed(("transit_service_alert",), ("id",), ("header",), (), ("description",), domain="transit"),
    "transit_static": Feed(("facility_status",), ("stop_id", "route_id"), ("stop_name", "route_long_name", "route_short_name"), ("feed_publish_date",), ("record_kind", "route_type", "zone_id", "location_type"), domain="transit", shape="gtfs"),
    "ferries": Feed(("ferry_status",), ("VesselID",), ("VesselName",), ("TimeStamp",), ("InService", "AtDock", "DepartingTerminalName", "ArrivingTerminalName", "LeftDock", "Eta", "ScheduledDeparture", "Speed", "Heading"), domain="transit"),
    "weather_alerts": Feed(("severe_weather", "official_emergency_notice"), ("id", "@id"), ("headline", "event"), ("onset", "effective", "sent", "updated"), ("event", "severity", "certainty", "urgency", "areaDesc", "expires", "ends", "instruction", "senderName"), domain="weather", retype=(("official_emergency_notice", ("evacuat.*", "shelter", "civil emergency")),)),
    "weather_stations": Feed(("weather_condition",), ("stationId", "station"), ("textDescription", "stationName"), ("timestamp",), ("temperature", "windSpeed", "windGust", "visibility", "relativeHumidity"), domain="weather"),
    "earthquakes": Feed(("earthquake",), ("id", "feature_id", "code"), ("title", "place"), ("time", "updated"), ("mag", "magType", "place", "felt", "alert", "tsunami", "sig", "status"), domain="hazard"),
    "critical_facilities": Feed(("facility_status",), ("name",), ("name",), (), ("category", "city", "state"), domain="reference"),
    "land_use": Feed(("population_context",), ("neighborhood",), ("neighborhood",), (), ("urban_center_type", "population_density_sq_mile", "job_density_sq_mile", "pedestrian_activity_index"), domain="reference"),
    "protest_events": Feed(("public_gathering_report",), ("id",), ("location_detail", "locality"), ("date",), ("event_type", "state", "size_mean", "size_low", "size_high", "arrests", "claims", "organizations"), "media", "history", "csv"),
    "crowd_counts": Feed(("public_gathering_report",), ("id",), ("location_detail", "location", "locality"), ("date",), ("type", "state", "size_mean", "size_cat", "arrests_any", "claims_summary", "claims"), "media", "history", "csv"),
    "count_cubes": Feed(("activity_context",), ("Country",), ("Country",), (), ("Month", "Year", "Events", "sheet"), "media", "history", "workbook"),
    "mass_mobilisation": Feed(("public_gathering_report",), ("id",), ("location", "country"), (), ("country", "year", "region", "participants", "protesterviolence"), "media", "history", "tsv"),
    "campaigns": Feed(("public_gathering_report",), ("id",), ("camp_goals", "location"), ("start_date",), ("year", "target", "camp_size", "success", "fatalities_low", "fatalities_high"), "media", "history", "tsv"),
    "conflicts": Feed(("violence_event",), ("id",), ("source_headline", "conflict_name"), ("date_start",), ("country", "year", "type_of_violence", "side_a", "side_b", "best", "high", "low"), "media", "history", "csv"),
    "news_coverage": Feed(("news_article",), ("id",), ("url",), ("date",), ("url",), "media", "history", "headerless"),
    "mobility": Feed(("activity_context",), ("cityid", "countyfips", "statefips"), ("cityname",), ("date",), ("year", "month", "day", "away_from_home", "transit_stations"), "media", "history", "csv"),
    "card_spend": Feed(("activity_context",), ("cityid",), ("cityname",), ("date",), ("year", "month", "day", "freq", "provisional"), "media", "history", "csv"),
    "employment": Feed(("activity_context",), ("countyfips",), ("countyfips",), ("date",), ("year", "month", "day_endofweek", "emp"), "media", "history", "csv"),
    "merchants": Feed(("activity_context",), ("countyfips",), ("countyfips",), ("date",), ("year", "month", "day_endofweek", "merchants_all", "revenue_all"), "media", "history", "csv"),
    "municipal_crime": Feed(("police_response",), ("id",), ("description", "request_type"), ("occurred_date", "reported_date"), ("crime_category", "status", "district", "beat", "arrest_made"), domain="history", shape="csv"),
    "fatal_shootings": Feed(("violence_event",), ("id",), ("city",), ("date",), ("state", "county", "armed_with", "threat_type", "flee_status", "body_camera"), "media", "history", "csv"),
    "highway_alerts": Feed(("traffic_condition", "road_closure", "road_construction", "bridge_restriction"), ("AlertID", "id"), ("HeadlineDescription", "Description"), ("LastUpdated", "StartTime"), ("AlertType", "SubType", "Route", "Direction", "LocationDescription"), domain="road",
                          retype=(("road_closure", ("closed", "closure")), ("road_construction", ("construction", "maintenance")), ("bridge_restriction", ("bridge",)))),
    "row_impacts": Feed(("traffic_condition", "road_closure", "road_construction"), ("id", "objectid"), ("description", "location"), ("start_date_time", "last_modified"), ("element", "type", "severity", "end_date_time"), domain="road", retype=(("road_closure", ("closure", "closed")), ("road_construction", ("construction", "paving")))),
    "transit_realtime": Feed(("transit_service_alert", "transit_delay"), ("tripId", "id"), ("status", "tripId"), ("expectedArrivalTime", "scheduleTime"), ("vehicleId", "scheduleRelationship", "predicted"), domain="transit", retype=(("transit_delay", ("delay.*", "late")),)),
}
# fixed values: column spellings of the cities' crime files, first to match
CRIME_DIALECTS = {
    "id": ("id", "incident_number", "report_number", "dc_key", "case_number", "incident_id"), "occurred_date": ("occurred_date", "date_occ", "dispatch_date_time", "offense_start_datetime", "date"),
    "description": ("description", "crm_cd_desc", "text_general_code", "offense", "primary_type"), "district": ("district", "area_name", "dc_dist", "precinct"), "lat": ("lat", "latitude", "point_y"), "lon": ("lon", "longitude", "point_x", "lng"),
}


def unify_dialects(rows: DataFrame, dialects: dict[str, tuple[str, ...]] = CRIME_DIALECTS) -> DataFrame:
    """Rows under the common column names, each from the first spelling that the file has."""
    names = {c.lower(): c for c in rows.columns}
    pick = lambda spellings: next((F.col(f"`{names[s]}`") for s in spellings if s in names), F.lit(None).cast("string"))
    return rows.select(*(pick(s).cast("string").alias(k) for k, s in dialects.items()))


def read(spark, name: str, path: str) -> DataFrame:
    """A feed's rows in the shape its files have."""
    shape = FEEDS[name].shape
    if shape == "json":
        return rd.json_records(spark, path)
    if shape == "gtfs":
        return rd.gtfs(spark, path)
    if shape == "workbook":
        return rd.workbook(spark, path)
    return rd.delimited(spark, path, sep="\t" if shape in ("tsv", "headerless") else ",", header=shape != "headerless")


class Said(NamedTuple):
    """What a record of a feed says, as expressions over its row; ``payload`` maps names to values, null where there is none."""

    record_id: Column
    kind: Column
    headline: Column
    event_time: Column
    known: Column
    place: Column
    payload: dict[str, Column]


def fields(feed: Feed) -> list[str]:
    """The input fields that a feed's specification names, and the spellings of coordinates."""
    return [*feed.ids, *feed.headline, *feed.times, *feed.payload, *feed.observed, *rd.LATITUDES, *rd.LONGITUDES]


def said(name: str, get: rd.Getter, is_json: bool) -> Said:
    """A feed's specification over a row whose fields ``get`` reads."""
    feed = FEEDS[name]
    first = lambda fields: F.coalesce(*(tx.clean(get(f)) for f in fields), F.lit(None).cast("string"))
    headline, at = tx.strip_html(first(feed.headline)), rd.when_of(get, feed.times)
    if feed.last_year is not None:
        slip = F.make_timestamp(F.lit(feed.slip_year), F.month(at), F.dayofmonth(at), F.hour(at), F.minute(at), F.second(at).cast("decimal(8,6)"))
        at = F.when(F.year(at) > feed.last_year, slip).otherwise(at)
    kind = F.lit(feed.kinds[0])
    body = F.concat_ws(" ", headline, *(get(f) for f in ("description",) if f in feed.payload or f in feed.headline))
    for other, words in reversed(feed.retype):
        kind = F.when(tx.has_word(body, words), other).otherwise(kind)
    return Said(first(feed.ids), kind, headline, at, rd.when_of(get, feed.observed), rd.location(get, is_json), {f: tx.clean(get(f)) for f in feed.payload})


def observations(rows: DataFrame, name: str, ingested_at=None) -> DataFrame:
    """Records of a feed as observations: stable id, type, headline, place, times, payload, provenance and quality."""
    feed = FEEDS[name]
    is_json = "record" in rows.columns
    rows, get = rd.parsed(rows, fields(feed))
    s = said(name, get, is_json)
    payload = F.map_filter(F.create_map(*(x for f, v in s.payload.items() for x in (F.lit(f), v))), lambda _, v: v.isNotNull()) if feed.payload else F.create_map().cast("map<string,string>")
    shown = rows.select(
        F.lit(name).alias("source_id"), s.record_id.alias("source_record_id"), s.kind.alias("observation_type"), s.headline.alias("headline"), s.event_time.alias("event_time"), s.place.alias("place"), payload.alias("payload"),
        F.lit(feed.authority).alias("authority"), F.lit(feed.domain).alias("domain"), s.known.alias("__known"),
    )
    content = F.sha2(F.concat_ws("|", "headline", F.to_json("payload")), 256)
    now = ingested_at if ingested_at is not None else F.current_timestamp()
    known = F.coalesce("event_time", now)
    if feed.observed:  # an event that is still to come was made known by now
        known = F.coalesce("__known", F.least(known, now))
    stamped = shown.withColumn("observed_at", known).drop("__known")
    return stamped.withColumns(
        {
            "observation_id": tx.deterministic_id("obs", F.col("source_id"), F.col("source_record_id"), F.col("observed_at"), content), "content_hash": content,
            "temporal_quality": F.lit(0.95), "spatial_quality": F.when(F.col("place").isNotNull(), 0.9).otherwise(0.5),
        }
    )


def coverage() -> dict[str, int]:
    """Feeds by domain."""
    out: dict[str, int] = {}
    for feed in FEEDS.values():
        out[feed.domain] = out.get(feed.domain, 0) + 1
    return out


def health(polls: DataFrame, now, interval_s: float, stale_after_s: float) -> DataFrame:
    """(source_id, state, error_rate, freshness_s) from a log of polls (source_id, at, ok, records)."""
    per = polls.groupBy("source_id").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last"), F.avg((~F.col("ok")).cast("double")).alias("error_rate"), F.sum("records").alias("records"))
    age = F.unix_micros(now) / 1e6 - F.unix_micros("last") / 1e6
    state = F.when(F.col("last").isNull(), "unknown").when(F.col("error_rate") > 0.5, "degraded").when(age > stale_after_s, "offline").when(age > 2 * interval_s, "delayed").otherwise("healthy")
    return per.select("source_id", state.alias("state"), F.round("error_rate", 6).alias("error_rate"), F.round(age, 3).alias("freshness_s"), "records")


def coverage_gaps(states: DataFrame) -> DataFrame:
    """(gap) ``source:usage`` of each source that is not real time by design, and ``source:state`` of each that is degraded,
    offline or unknown, of rows (source_id, usage, state)."""
    piece = lambda when, c: F.when(when, F.concat_ws(":", "source_id", c))
    both = F.array_compact(F.array(piece(F.col("usage") != "realtime", "usage"), piece(F.col("state").isin("degraded", "offline", "unknown"), "state")))
    return states.select(F.explode(both).alias("gap"))


def series(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide change series as rows (keys, name, value), missing markers dropped."""
    return rows.unpivot(keys, columns, "name", "said").withColumn("value", tx.number(F.col("said").cast("string"))).where("value IS NOT NULL").drop("said")


def write_raw(rows: DataFrame, root: str) -> None:
    """Raw payloads by source and hour; the writer's commit makes a batch appear whole."""
    at = F.col("ingested_at")
    rows.withColumns({"y": F.year(at), "m": F.month(at), "d": F.day(at), "h": F.hour(at)}).write.partitionBy("source_id", "y", "m", "d", "h").mode("append").json(root)


def kafka_options(servers: str, topic: str) -> dict[str, str]:
    """Options of the Kafka source and sink of a topic (needs Spark's Kafka package on the class path)."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "topic": topic, "startingOffsets": "earliest", "kafka.acks": "all"}
