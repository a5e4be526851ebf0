"""Text, classification and parsing queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text as tx
from .registry import Tables, query

# fixed values: words of the significance rules
CRITICAL = ("collision", "crash", "accident", "fire", "smoke", "shooting", "shots", "gunshot", "assault", "robbery", "rescue", "overdose", "cardiac", "extrication", "hazard", "block", "closure", "closed", "collapse", "earthquake", "protest", "riot", "outage", "spill", "bomb", "weapon")
ROUTINE = ("directed patrol", "premise check", "prevention check", "area check", "business check", "traffic stop", "barking dog", "parking enforcement", "abandoned vehicle", "found property", "training", "administrative", "detail")
NEWS = ("crash", "collision", "killed", "injured", "victim", "fire", "explosion", "police", "suspect", "arrested", "shooting", "shot", "protest", "demonstration", "march", "closure", "shut down", "earthquake", "flood", "wildfire", "storm", "warning", "outage", "derailment")
STEADY = ("road clear", "normal traffic", "all lanes open", "open to traffic", "ferry at dock", "in service", "operating normally", "on schedule", "no restrictions")
HAZARDS = ("earthquake", "severe_weather", "flooding", "wildfire", "official_emergency_notice")
DISPATCH = ("fire_dispatch", "police_response", "violence_event")
ROAD = ("road_closure", "road_construction", "bridge_restriction", "power_outage", "water_outage", "transit_service_alert")
SENSORS = ("traffic_flow", "traffic_condition", "travel_time", "vehicle_position", "ferry_status", "camera_imagery", "facility_status")
CONTEXT = ("permit_event", "population_context", "activity_context")


def significance(kind: Column, headline: Column, body: Column) -> Column:
    """event_candidate, state_only, context or noise by an ordered cascade of type and wording."""
    both = F.concat_ws(" ", headline, body)
    return (
        F.when(kind.isin(*HAZARDS), "event_candidate")
        .when(kind.isin(*DISPATCH) & tx.has_word(headline, CRITICAL), "event_candidate")
        .when(kind.isin(*DISPATCH) & tx.has_word(headline, ROUTINE), "noise")
        .when(kind.isin(*DISPATCH), "event_candidate")
        .when(kind.isin(*ROAD) & tx.has_word(both, STEADY), "state_only")
        .when(kind.isin(*ROAD), "event_candidate")
        .when(kind.isin(*SENSORS) & (tx.has_word(both, CRITICAL) | F.lower(both).contains("blocked")), "event_candidate")
        .when(kind.isin(*SENSORS), "state_only")
        .when(kind.isin(*CONTEXT), "context")
        .when(kind == "news_article", F.when(tx.has_word(both, NEWS), "event_candidate").otherwise("noise"))
        .otherwise("event_candidate")
    )


#: The fixture's observation types and headlines: event types as feeds, words of the order table as dispatch text.
KIND_OF = {"view": "traffic_flow", "click": "news_article", "error": "fire_dispatch", "purchase": "road_closure", "signup": "permit_event"}
HEADLINES = ("directed patrol on 5th", "crash on I-5 closed", "all lanes open", "storm warning issued", "ferry at dock", "barking dog", "smoke reported")


def typed(t: Tables) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in KIND_OF.items() for x in kv))
    line = F.element_at(F.array(*map(F.lit, HEADLINES)), (F.col("k") % len(HEADLINES) + 1).cast("int"))
    return t.obs.withColumns({"type": names[F.col("kind")], "headline": line})


def _words(column: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches(lower({column}), '(?:^|[^a-z0-9_])(?:{'|'.join(words)})(?:[^a-z0-9_]|$)')"


TYPED = ", typed AS (SELECT *, CASE kind " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KIND_OF.items()) + " END AS type, ([" + ", ".join(f"'{h}'" for h in HEADLINES) + f"])[k % {len(HEADLINES)} + 1] AS headline FROM obs)"
CLASSED = TYPED + f""", classed AS (SELECT *, CASE WHEN type = 'fire_dispatch' AND {_words('headline', CRITICAL)} THEN 'event_candidate' WHEN type = 'fire_dispatch' AND {_words('headline', ROUTINE)} THEN 'noise'
 WHEN type = 'fire_dispatch' THEN 'event_candidate' WHEN type = 'road_closure' AND {_words('headline', STEADY)} THEN 'state_only' WHEN type = 'road_closure' THEN 'event_candidate'
 WHEN type = 'traffic_flow' AND ({_words('headline', CRITICAL)} OR contains(headline, 'blocked')) THEN 'event_candidate' WHEN type = 'traffic_flow' THEN 'state_only' WHEN type = 'permit_event' THEN 'context'
 WHEN {_words('headline', NEWS)} THEN 'event_candidate' ELSE 'noise' END AS class FROM typed)"""


def classed(t: Tables) -> DataFrame:
    return typed(t).withColumn("class", significance(F.col("type"), F.col("headline"), F.lit("")))


@query(CLASSED + """, b AS (SELECT source_id, us // 900000000 AS bucket, count(*) AS n, count(DISTINCT k) AS topics, sum(value) AS total FROM classed WHERE class = 'event_candidate' GROUP BY ALL)
SELECT source_id, count(*) AS buckets, sum(n)::BIGINT AS n, max(n) AS peak, max(topics) AS most_topics, round(sum(total), 4) AS total FROM b GROUP BY source_id ORDER BY n DESC, source_id LIMIT 100""", obs=True)
def recent_material_activity(t: Tables) -> DataFrame:
    rows = classed(t).where("class = 'event_candidate'")
    per = rows.groupBy("source_id", F.floor(F.col("us") / 900_000_000).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("topics"), F.sum("value").alias("total"))
    out = per.groupBy("source_id").agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("n"), F.max("n").alias("peak"), F.max("topics").alias("most_topics"), F.round(F.sum("total"), 4).alias("total"))
    return out.orderBy(F.desc("n"), "source_id").limit(100)


@query(CLASSED + " SELECT type, class, count(*) AS n FROM classed GROUP BY ALL", obs=True)
def sig_class_counts(t: Tables) -> DataFrame:
    return classed(t).groupBy("type", "class").agg(F.count(F.lit(1)).alias("n"))


@query(TYPED + """ SELECT CASE WHEN type = 'road_closure' OR regexp_matches(headline, 'closure|closed|blocked|construction|outage|restriction|road work') THEN 'condition' ELSE 'incident' END AS event_kind,
CASE WHEN type = 'permit_event' THEN 'scheduled' WHEN (SELECT max(us) FROM obs) - us > 86400000000 THEN 'historical' WHEN regexp_matches(headline, 'all lanes open|cleared|reopened') THEN 'ended' ELSE 'active' END AS phase, count(*) AS n FROM typed GROUP BY ALL""", obs=True)
def event_kind_phase(t: Tables) -> DataFrame:
    rows = typed(t).crossJoin(F.broadcast(t.obs.agg(F.max("us").alias("now"))))
    kind = F.when((F.col("type") == "road_closure") | F.col("headline").rlike("closure|closed|blocked|construction|outage|restriction|road work"), "condition").otherwise("incident")
    phase = F.when(F.col("type") == "permit_event", "scheduled").when(F.col("now") - F.col("us") > 86_400_000_000, "historical").when(F.col("headline").rlike("all lanes open|cleared|reopened"), "ended").otherwise("active")
    return rows.groupBy(kind.alias("event_kind"), phase.alias("phase")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(trim(coalesce(url, '')), '#.*$', '') AS u FROM pages),
q AS (SELECT page_id, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1) AS head, u, list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND string_split(x, '=')[1] NOT IN ('ref', 'fbclid', 'gclid', 'ocid')) AS params FROM p)
SELECT page_id, lower(head) || regexp_replace(regexp_extract(substr(u, length(head) + 1), '^([^?]*)', 1), '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url FROM q""")
def url_canonical(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.canonical_url(F.col("url")).alias("url"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;|' || chr(160), ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS body FROM pages")
def strip_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.strip_html(F.col("html")).alias("body"))


#: The tokens' statement has its own lists, so that a word missing in the library shows.
_ROAD_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),
 '(^|[^a-z0-9_])(?:interstate\s*|i-?)(5|90|405)([^a-z0-9_]|$)', '\1i_\2\3', 'g'), '(^|[^a-z0-9_])(?:state\s*route\s*|sr-?|wa-?)(99|520|522|167|16|2)([^a-z0-9_]|$)', '\1sr_\2\3', 'g'),
 '(^|[^a-z0-9_])(?:u\.?s\.?\s*route\s*|us-?)(2|101)([^a-z0-9_]|$)', '\1us_\2\3', 'g'), '(^|[^a-z0-9_])exit\s*#?\s*([0-9]+[a-z]?)([^a-z0-9_]|$)', '\1exit_\2\3', 'g'),
 '(^|[^a-z0-9_])milepost\s*#?\s*([0-9]+)([^a-z0-9_]|$)', '\1mp_\2\3', 'g')"""
_SAME = """CASE WHEN w IN ('blocked', 'blockage', 'blocking', 'closed', 'closures', 'shutdown') THEN 'closure' WHEN w IN ('delays', 'congestion', 'slowdown', 'slow', 'stalled') THEN 'delay' ELSE w END"""
_STOP = """'the', 'a', 'an', 'and', 'or', 'of', 'in', 'on', 'at', 'to', 'for', 'is', 'are', 'was', 'were', 'has', 'have', 'with', 'by', 'from', 'as', 'it', 'this', 'that', 'these', 'those', 'be', 'been', 'being', 'not', 'all',
 'reported', 'reports', 'reporting', 'update', 'updates', 'updated', 'assistance', 'rendered', 'directed', 'patrol', 'activity', 'checks', 'prevention', 'priority', 'call', 'calls', 'handling', 'officer', 'officers',
 'police', 'response', 'dispatch', 'dispatched', 'investigation', 'investigating', 'incident', 'incidents', 'premise', 'service', 'unit', 'units', 'scene', 'unable', 'locate', 'complainant', 'problem', 'solving', 'project',
 'seattle', 'washington', 'department', 'issued', 'alert', 'alerts', 'article', 'news', 'story', 'stories', 'media', 'block', 'ave', 'st'"""
TOKENS = f""", tok AS (SELECT conv_id, turn, coalesce(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({_ROAD_SQL}, '[a-z0-9_]+'), lambda w: {_SAME}), lambda w: w NOT IN ({_STOP}) AND (length(w) >= 3 OR regexp_matches(w, '^(?:i|sr|us|exit|mp)_'))))), []) AS ts FROM conversations)"""


@query("WITH one AS (SELECT 1)" + TOKENS + """ SELECT a.conv_id, a.turn, len(a.ts) AS own, len(list_intersect(a.ts, b.ts)) AS shared, round(CASE WHEN len(a.ts) > 0 THEN len(list_intersect(a.ts, b.ts)) / len(a.ts) ELSE 0 END, 6) AS share FROM tok a JOIN tok b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def token_overlap(t: Tables) -> DataFrame:
    tok = t.conversations.select("conv_id", "turn", tx.tokens(F.col("text")).alias("ts"))
    nxt = tok.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ts").alias("other"))
    return tok.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.size("ts").cast("long").alias("own"), F.size(F.array_intersect("ts", "other")).cast("long").alias("shared"), F.round(tx.overlap(F.col("ts"), F.col("other")), 6).alias("share"))


SOURCES = (("cam", "traffic"), ("traffic", "traffic"), ("wx", "weather"), ("nws", "weather"), ("fire", "safety"), ("police", "safety"), ("src1", "transit"), ("src2", "news"))


@query("SELECT coalesce(source, 'none') AS source, CASE " + " ".join(f"WHEN contains(source, '{a}') THEN '{b}'" for a, b in SOURCES) + " ELSE 'other' END AS domain, count(*) AS n FROM documents GROUP BY ALL")
def source_domain(t: Tables) -> DataFrame:
    domain = F.lit("other")
    for part, name in reversed(SOURCES):
        domain = F.when(F.col("source").contains(part), name).otherwise(domain)
    return t.documents.groupBy(F.coalesce("source", F.lit("none")).alias("source"), domain.alias("domain")).agg(F.count(F.lit(1)).alias("n"))


_UNIT_CASE = "CASE k % 5 WHEN 0 THEN 'mph' WHEN 1 THEN 'miles' WHEN 2 THEN 'people' WHEN 3 THEN 'acres' ELSE 'odd' END"


@query(f""", s AS (SELECT observation_id, CAST(k AS VARCHAR) || ' ' || {_UNIT_CASE} AS said, k FROM obs)
SELECT observation_id, CASE WHEN k % 5 < 4 THEN k::DOUBLE END AS value, CASE k % 5 WHEN 0 THEN 'm/s' WHEN 1 THEN 'm' WHEN 2 THEN 'people' WHEN 3 THEN 'm2' END AS canonical,
round(k * CASE k % 5 WHEN 0 THEN CAST(0.44704 AS DOUBLE) WHEN 1 THEN 1609.344 WHEN 2 THEN 1.0 WHEN 3 THEN 4046.8564224 END, 4) AS amount FROM s""", obs=True)
def quantity_units(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("mph", "miles", "people", "acres", "odd"))), (F.col("k") % 5 + 1).cast("int"))
    q = tx.quantity(F.concat_ws(" ", F.col("k").cast("string"), unit))
    return t.obs.select("observation_id", q.alias("q")).select("observation_id", "q.value", "q.canonical", F.round("q.amount", 4).alias("amount"))


@query(" SELECT observation_id, epoch_us(CASE observation_id % 4 WHEN 0 THEN make_timestamp(us // 1000000 * 1000000) WHEN 1 THEN make_timestamp(us // 1000 * 1000) WHEN 2 THEN date_trunc('second', event_time) WHEN 3 THEN date_trunc('day', event_time) END) AS us FROM obs", obs=True)
def feed_times(t: Tables) -> DataFrame:
    at = F.col("event_time")
    said = F.element_at(
        F.array(F.floor(F.col("us") / 1_000_000).cast("string"), F.concat(F.lit("/Date("), F.floor(F.col("us") / 1000).cast("string"), F.lit(")/")), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.date_format(at, "MM/dd/yyyy")),
        (F.col("observation_id") % 4 + 1).cast("int"),
    )
    return t.obs.select("observation_id", F.unix_micros(tx.feed_time(said)).alias("us"))


@query("""SELECT doc_id, CASE WHEN lower(trim(coalesce(source, ''))) NOT IN ('', 'na', 'n/a', 'nan', 'none', 'null', '-', '--', 'unknown', 'not available') THEN trim(source) END AS source, TRY_CAST(regexp_replace(CAST(n_chars AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN ',0' ELSE 'x' END, '[, ]', '', 'g') AS DOUBLE) AS n,
CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false END AS flag FROM documents""")
def cleaned_fields(t: Tables) -> DataFrame:
    said = F.concat(F.col("n_chars").cast("string"), F.when(F.col("doc_id") % 2 == 0, ",0").otherwise("x"))
    word = F.element_at(F.array(F.lit(" Yes"), F.lit("no"), F.lit("perhaps")), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.documents.select("doc_id", tx.clean(F.col("source")).alias("source"), tx.number(said).alias("n"), tx.flag(word).alias("flag"))


@query(r"""SELECT event_id, j.key AS field, CAST(j.value AS VARCHAR) AS said FROM events, json_each(props) j""")
def json_walk(t: Tables) -> DataFrame:
    """Payload fields as rows of (field, value): the record's claims."""
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("field", "said"))


@query(""", b AS (SELECT observation_id, kind || ':' || (us // 900000000) || ':' || CAST(floor(lat * 111320.0 / 750) AS BIGINT) || ':' || CAST(floor(lon * 111320.0 * cos(radians(lat)) / 750) AS BIGINT) AS base FROM obs)
SELECT observation_id, base, row_number() OVER (PARTITION BY base ORDER BY observation_id) - 1 AS ordinal FROM b""", obs=True)
def event_identity(t: Tables) -> DataFrame:
    """Type, quarter-hour and cell as an event's base id, with an ordinal among equal bases."""
    from pyspark.sql import Window

    base = F.concat_ws(":", "kind", F.floor(F.col("us") / 900_000_000).cast("string"), geo.geo_cell(F.col("lon"), F.col("lat")))
    rows = t.obs.select("observation_id", base.alias("base"))
    return rows.withColumn("ordinal", (F.row_number().over(Window.partitionBy("base").orderBy("observation_id")) - 1).cast("long"))
