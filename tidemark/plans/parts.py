"""Smaller parts of states and worlds: names, durations, primary quantities, coverage gaps, strongest changes, forecast reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import exposure as ex
from ..operators import measures as ms
from ..operators import ordered as od
from ..sources import feeds
from . import aggregates, reads
from .registry import ORACLES, Tables, query
from .scoring import F_SQL, features

#: The registered statement of the quantities, as the first of others' expressions.
_MAGNITUDES = ORACLES["magnitudes"].replace("SELECT event_key, quantity, round(CASE", ", m AS (SELECT event_key, quantity, round(CASE", 1) + ")"
_DELTAS = ORACLES["state_deltas"].replace("SELECT event_key, version, change, round(CAST(least(1.0, m)", ", g AS (SELECT event_key, version, change, round(CAST(least(1.0, m)", 1) + ")"

# fixed values: the rank of quantities that characterise an event
PRIORITY = {"error": 1, "purchase": 2, "view": 3}


@query(_MAGNITUDES + " SELECT event_key, quantity, low, high, confidence FROM m QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY CASE quantity WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 99 END, confidence DESC, quantity) = 1")
def primary_quantity(t: Tables) -> DataFrame:
    """The quantity that best characterises each event: by rank, then by confidence."""
    rank = F.lit(99)
    for name, place in PRIORITY.items():
        rank = F.when(F.col("quantity") == name, place).otherwise(rank)
    first = F.min_by(F.struct("quantity", "low", "high", "confidence"), F.struct(rank, -F.col("confidence"), F.col("quantity"))).alias("q")
    return aggregates.magnitudes(t).groupBy("event_key").agg(first).select("event_key", "q.*")


@query(", e AS (SELECT event_key, min(us) AS a, max(us) AS b, max(us + k * 60000000) AS seen FROM obs GROUP BY event_key), w AS (SELECT max(us) AS now FROM obs) SELECT event_key, greatest(0.0, (now - a) / 1e6)::DOUBLE AS elapsed_s, (b - a) / 1e6 AS span_s, a AS first_us, seen AS seen_us, greatest(0.0, (now - seen) / 1e6)::DOUBLE AS silence_s FROM e, w", obs=True)
def event_durations(t: Tables) -> DataFrame:
    """How long each event has run, was active and has been silent; reports are seen some minutes after they happen."""
    seen = F.max(F.col("us") + F.col("k") * 60_000_000).alias("seen_us")
    e = t.obs.groupBy("event_key").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), seen)
    now = t.obs.agg(F.max("us").alias("now"))  # one row
    since = lambda c: F.greatest(F.lit(0.0), (F.col("now") - F.col(c)) / 1e6)
    return e.crossJoin(F.broadcast(now)).select("event_key", since("first_us").alias("elapsed_s"), ((F.col("last_us") - F.col("first_us")) / 1e6).alias("span_s"), "first_us", "seen_us", since("seen_us").alias("silence_s"))


@query(""", n AS (SELECT event_key, us, observation_id, substr(coalesce(CASE WHEN k % 3 = 0 THEN 'Line ' || k END, CASE WHEN k % 5 = 0 THEN repeat('Long street ', 20) || k END, CASE WHEN k % 7 = 1 THEN 'Corner ' || source_id END, kind), 1, 120) AS name FROM obs)
SELECT event_key, arg_max(name, {'u': us, 'o': observation_id}) AS name, count(DISTINCT name) AS names FROM n GROUP BY event_key""", obs=True)
def event_names(t: Tables) -> DataFrame:
    """What an event's infrastructure is called: the first field that names it, else the headline; the latest report decides."""
    k = F.col("k")
    fields = {"route_long": F.when(k % 3 == 0, F.concat(F.lit("Line "), k)).otherwise(""), "street": F.when(k % 5 == 0, F.concat(F.repeat(F.lit("Long street "), F.lit(20)), k)), "location": F.when(k % 7 == 1, F.concat(F.lit("Corner "), "source_id"))}
    named = t.obs.select("event_key", "us", "observation_id", tx.infrastructure_name(F.create_map(*(x for n, v in fields.items() for x in (F.lit(n), v))), F.col("kind")).alias("name"))
    return named.groupBy("event_key").agg(F.max_by("name", F.struct("us", "observation_id")).alias("name"), F.count_distinct("name").alias("names"))


@query("""WITH p AS (SELECT coalesce(source, 'none') AS source_id, doc_id % 100 AS minute, n_chars >= 200 AS ok FROM documents), h AS (SELECT source_id, max(minute) FILTER (ok) AS last, avg((NOT coalesce(ok, false))::INT::DOUBLE) AS rate FROM p GROUP BY source_id),
s AS (SELECT source_id, CASE WHEN last IS NULL THEN 'unknown' WHEN rate > 0.5 THEN 'degraded' WHEN 100 - last > 60 THEN 'offline' WHEN (100 - last) * 60 > 480 THEN 'delayed' ELSE 'healthy' END AS state, CASE WHEN length(source_id) % 3 = 0 THEN 'historical' WHEN length(source_id) % 3 = 1 THEN 'context' ELSE 'realtime' END AS usage FROM h)
SELECT source_id || ':' || usage AS gap FROM s WHERE usage <> 'realtime' UNION ALL SELECT source_id || ':' || state FROM s WHERE state IN ('degraded', 'offline', 'unknown')""")
def coverage_gaps(t: Tables) -> DataFrame:
    """Sources that can't add to the picture of now: by design, since their usage is not real time, or by their state."""
    minute = F.col("doc_id") % 100
    at = F.timestamp_seconds(F.lit(1_704_067_200) + minute * 60)
    polls = t.documents.select(F.coalesce("source", F.lit("none")).alias("source_id"), at.alias("at"), F.coalesce(F.col("n_chars") >= 200, F.lit(False)).alias("ok"), F.lit(1).alias("records"))
    states = feeds.health(polls, F.timestamp_seconds(F.lit(1_704_067_200 + 6000)), 240.0, 3600.0)
    size = F.length("source_id") % 3
    return feeds.coverage_gaps(states.withColumn("usage", F.when(size == 0, "historical").when(size == 1, "context").otherwise("realtime")))


@query(_DELTAS + ", w AS (SELECT max(version) - 9 AS since FROM v) SELECT event_key, version, change, magnitude FROM g, w WHERE version >= since QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY magnitude DESC, version, change) = 1")
def material_index(t: Tables) -> DataFrame:
    """The strongest change of each event in the last ten days of versions; of equal ones the earliest."""
    last = reads.day_versions(t).agg((F.max("version") - 9).alias("since"))  # one row
    recent = reads.state_deltas(t).crossJoin(F.broadcast(last)).where("version >= since")
    best = F.min(F.struct((-F.col("magnitude")).alias("m"), "version", "change")).alias("b")
    return recent.groupBy("event_key").agg(best).select("event_key", "b.version", "b.change", (-F.col("b.m")).alias("magnitude"))


@query("""WITH s AS (SELECT coalesce(source, 'none') AS model_id, least(1.0, n_chars / 5000.0) AS p, toxic AS y, (doc_id % 90)::DOUBLE AS lead FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND n_chars IS NOT NULL),
b AS (SELECT model_id, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM s GROUP BY ALL), e AS (SELECT model_id, sum(n * gap) / sum(n) AS ece FROM b GROUP BY model_id),
c AS (SELECT model_id, count(*) AS n, avg(power(p - y, 2)) AS brier, avg(abs(p - y)) AS mae, avg(lead) AS lead, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM s GROUP BY model_id)
SELECT model_id, n, round(brier, 6) AS brier, round(ece, 6) AS ece, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
 round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_alarm, round(coalesce(fn / nullif(tp + fn, 0), 0), 6) AS missed, round(mae, 6) AS mae, round(sqrt(brier), 6) AS rmse, round(lead, 1) AS lead_min FROM c JOIN e USING (model_id)""")
def forecast_report(t: Tables) -> DataFrame:
    """Every measure of each model's forecasts with their mean lead time, from one pass over the outcomes."""
    d = t.documents.select("doc_id", F.coalesce("source", F.lit("none")).alias("model_id"), F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p"), (F.col("doc_id") % 90).alias("lead"))
    rows = d.join(t.labels.select("doc_id", F.col("toxic").alias("y")), "doc_id")
    r = ms.forecast_report(rows, "model_id", "p", "y", "lead")
    return r.select("model_id", "n", *(F.round(c, 6).alias(c) for c in ("brier", "ece", "precision", "recall", "f1", "false_alarm", "missed", "mae", "rmse")), F.round("lead", 1).alias("lead_min"))


_LAST = ", n AS (SELECT max(us) AS now FROM obs)"


@query(F_SQL + _LAST + """, w AS (SELECT event_key % 4 AS region, event_key, (now - last_us) / 1e6 < 21600 AS changed, CASE WHEN official THEN 4 WHEN crowd >= 400 THEN 3 WHEN crowd >= 200 THEN 2 ELSE 1 END AS severity, roads + routes AS impacts, authority, sources, (now - last_us) / 1e6 AS age FROM f, n)
SELECT region, event_key, changed, severity, impacts, row_number() OVER (PARTITION BY region ORDER BY changed DESC, severity DESC, impacts DESC, authority DESC, sources DESC, age, event_key) AS place FROM w""", obs=True)
def world_ranking(t: Tables) -> DataFrame:
    """Events of each region, the most actionable first: what moved, how bad, how much is hit, how sure, how corroborated, how recent."""
    now = t.obs.agg(F.max("us").alias("now"))  # one row
    age = (F.col("now") - F.col("last_us")) / 1e6
    severity = F.when(F.col("official"), 4).when(F.col("crowd") >= 400, 3).when(F.col("crowd") >= 200, 2).otherwise(1)
    w = features(t).crossJoin(F.broadcast(now)).select((F.col("event_key") % 4).alias("region"), "event_key", (age < 21_600).alias("changed"), severity.alias("severity"), (F.col("roads") + F.col("routes")).alias("impacts"), "authority", "sources", age.alias("age"))
    first = Window.partitionBy("region").orderBy(*(F.desc(c) for c in ("changed", "severity", "impacts", "authority", "sources")), "age", "event_key")
    return w.select("region", "event_key", "changed", "severity", "impacts", F.row_number().over(first).cast("long").alias("place"))


@query(F_SQL + """, g AS (SELECT event_key, [{'v': CASE WHEN reliability < 0.5 THEN 0.8 ELSE 0 END, 'g': 'event_geometry'}, {'v': CASE WHEN roads > 0 AND routes = 0 THEN 0.7 ELSE 0 END + CASE WHEN n % 3 = 0 THEN 0.3 ELSE 0 END, 'g': 'road_status'},
 {'v': CASE WHEN sources < 2 THEN 0.5 ELSE 0 END + 0.3 * least(3, roads % 4), 'g': 'crowd_size'}, {'v': CASE WHEN NOT official AND sources >= 2 THEN 0.2 ELSE 0 END, 'g': 'official_guidance'}] AS l FROM f), u AS (SELECT event_key, unnest(l) AS x FROM g)
SELECT event_key, x.g AS gap, round(least(1.0, x.v), 4)::DOUBLE AS value, row_number() OVER (PARTITION BY event_key ORDER BY round(x.v, 6) DESC, x.g) AS rank FROM u WHERE x.v > 0""", obs=True)
def information_gaps(t: Tables) -> DataFrame:
    """What is not known of each event, by what knowing it is worth (fixed values: the worths)."""
    when = lambda c, v: F.when(c, v).otherwise(0.0)
    worth = {
        "event_geometry": when(F.col("reliability") < 0.5, 0.8), "road_status": when((F.col("roads") > 0) & (F.col("routes") == 0), 0.7) + when(F.col("n") % 3 == 0, 0.3),
        "crowd_size": when(F.col("sources") < 2, 0.5) + F.least(F.lit(3), F.col("roads") % 4) * 0.3, "official_guidance": when(~F.col("official") & (F.col("sources") >= 2), 0.2),
    }
    every = F.array(*(F.struct((-F.round(v, 6)).alias("v"), F.lit(g).alias("gap")) for g, v in worth.items()))
    ranked = F.array_sort(F.filter(every, lambda x: x["v"] < 0))
    rows = features(t).select("event_key", F.posexplode(ranked).alias("rank", "x"))
    return rows.select("event_key", "x.gap", F.round(F.least(F.lit(1.0), -F.col("x.v")), 4).alias("value"), (F.col("rank") + 1).cast("long").alias("rank"))


@query(""", l AS (SELECT *, lag(k) OVER w AS before, row_number() OVER w = 1 AS new FROM obs WINDOW w AS (PARTITION BY source_id, event_key ORDER BY us, observation_id)),
b AS (SELECT *, CASE WHEN k >= 72 THEN 4 WHEN k >= 48 THEN 3 WHEN k >= 26 THEN 2 WHEN k >= 2 THEN 1 ELSE 0 END AS level, CASE WHEN before >= 72 THEN 4 WHEN before >= 48 THEN 3 WHEN before >= 26 THEN 2 WHEN before >= 2 THEN 1 ELSE 0 END AS old, kind = 'error' AND value >= 400 AS official FROM l)
SELECT observation_id, CASE WHEN level = 0 AND NOT official THEN NULL WHEN official AND k >= 20 THEN 'official_guidance' WHEN new THEN 'new_event' WHEN level > old THEN 'escalation' WHEN kind = 'view' AND k % 2 = 0 THEN 'route_change' WHEN kind = 'purchase' THEN 'impact_change' WHEN kind = 'signup' THEN 'status_change' ELSE 'location_change' END AS reason FROM b""", obs=True)
def notification_reasons(t: Tables) -> DataFrame:
    """Why a user would be told, the first reason that applies; nobody is told of an exposure of none without official guidance."""
    level = lambda c: tx.ladder(c, [(72, "4"), (48, "3"), (26, "2"), (2, "1")], "0").cast("int")
    seen = od.lagged(t.obs.select("source_id", "event_key", "us", "observation_id", "kind", "k", "value"), ["source_id", "event_key"], ["us", "observation_id"], ["k"])
    official = (F.col("kind") == "error") & (F.col("value") >= 400)
    reason = ex.notification_reason(
        level(F.col("k")), official, F.col("k") >= 20, F.col("__before").isNull(), level(F.col("__before")["k"]), (F.col("kind") == "view") & (F.col("k") % 2 == 0), F.col("kind") == "purchase", F.col("kind") == "signup",
    )
    return seen.select("observation_id", reason.alias("reason"))


@query(F_SQL + " SELECT event_key, round(0.3 * authority + 0.2 * least(1.0, sources / 3.0) + 0.2 * reliability + 0.3 * ((roads + 0.7 * routes + 0.35 * (n - roads - routes)) / n), 4)::DOUBLE AS confidence FROM f", obs=True)
def exposure_confidence(t: Tables) -> DataFrame:
    """How sure a user's exposure is: authority, corroboration, place and the truth of the impacts (fixed values: the weights)."""
    truth = (F.col("roads") + F.col("routes") * 0.7 + (F.col("n") - F.col("roads") - F.col("routes")) * 0.35) / F.col("n")
    blend = F.col("authority") * 0.3 + F.least(F.lit(1.0), F.col("sources") / 3.0) * 0.2 + F.col("reliability") * 0.2 + truth * 0.3
    return features(t).select("event_key", F.round(blend, 4).alias("confidence"))
