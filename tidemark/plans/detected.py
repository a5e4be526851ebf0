"""Changes of place, heading and impacts between versions; medians by recency; models and their outputs; a reader's summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import delta, ledger as op, measures as ms, metrics as mt, models as md
from .reads import VERSIONS_SQL, day_versions
from .registry import Tables, haversine_sql, query
from .scoring import F_SQL, features, presentation_items

_DAY_US = 86_400_000_000
_DAY = f"us // {_DAY_US}"


def _day():
    return F.floor(F.col("us") / _DAY_US).cast("long").alias("version")


@query(f""", b AS (SELECT event_key, {_DAY} AS version, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM obs GROUP BY ALL),
g AS (SELECT event_key, version, (x0 + x1) / 2 AS lon, (y0 + y1) / 2 AS lat, (x1 - x0) * (y1 - y0) * {geo.DEGREE_M} * {geo.DEGREE_M} * cos(radians((y0 + y1) / 2)) AS area FROM b),
l AS (SELECT *, lag(lon) OVER w AS px, lag(lat) OVER w AS py, lag(area) OVER w AS pa FROM g WINDOW w AS (PARTITION BY event_key ORDER BY version)),
s AS (SELECT event_key, version, least(1.0, {haversine_sql('px', 'py', 'lon', 'lat')} / 1200) AS shift, CASE WHEN pa > 0 THEN greatest(0.0, (area - pa) / pa) WHEN area > 0 THEN 1.0 ELSE 0.0 END AS growth FROM l WHERE px IS NOT NULL)
SELECT event_key, version, CASE WHEN shift >= growth THEN 'event_geometry_displaced' ELSE 'event_footprint_expanded' END AS change, round(least(1.0, 0.6 * shift + 0.4 * least(1.0, growth)), 4) AS magnitude FROM s WHERE shift >= 0.02 OR growth >= 0.05""", obs=True)
def geometry_deltas(t: Tables) -> DataFrame:
    """Footprints (the box of a day's reports) that moved or grew since the event's day before."""
    box = t.obs.groupBy("event_key", _day()).agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    states = box.select("event_key", "version", ((F.col("x0") + F.col("x1")) / 2).alias("lon"), ((F.col("y0") + F.col("y1")) / 2).alias("lat"), geo.area_m2(ring).alias("area"))
    return delta.geometry(states, "event_key", "version")


@query(f""", e AS (SELECT event_key, {_DAY} AS version, arg_min(lon, (us, observation_id)) AS x0, arg_min(lat, (us, observation_id)) AS y0, arg_max(lon, (us, observation_id)) AS x1, arg_max(lat, (us, observation_id)) AS y1 FROM obs GROUP BY ALL),
m AS (SELECT event_key, version, {haversine_sql('x0', 'y0', 'x1', 'y1')} >= 3000 AS moving, round(degrees(atan2(x1 - x0, y1 - y0)), 1) AS bearing FROM e), d AS (SELECT event_key, version, moving, CASE WHEN moving THEN bearing END AS direction FROM m),
l AS (SELECT *, lag(moving) OVER w AS pm, lag(direction) OVER w AS pd FROM d WINDOW w AS (PARTITION BY event_key ORDER BY version))
SELECT event_key, version, CASE WHEN abs(((pd - direction + 180) % 360 + 360) % 360 - 180) > 30 THEN 'event_direction_changed' WHEN moving THEN 'movement_started' ELSE 'movement_stopped' END AS change, CAST(CASE WHEN moving THEN 0.7 ELSE 0.35 END AS DOUBLE) AS magnitude
FROM l WHERE pm IS NOT NULL AND (moving <> pm OR direction IS DISTINCT FROM pd)""", obs=True)
def heading_deltas(t: Tables) -> DataFrame:
    """Events that set off, stopped or turned: a day's heading runs from its first report to its last, if 3 km apart."""
    at, end = F.struct("us", "observation_id"), F.struct("lon", "lat")
    ends = t.obs.groupBy("event_key", _day()).agg(F.min_by(end, at).alias("a"), F.max_by(end, at).alias("b"))
    far = geo.haversine_m(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")) >= 3000
    bearing = F.round(F.degrees(F.atan2(F.col("b.lon") - F.col("a.lon"), F.col("b.lat") - F.col("a.lat"))), 1)
    return delta.heading(ends.select("event_key", "version", far.alias("moving"), F.when(far, bearing).alias("direction")), "event_key", "version")


@query(f""", v AS (SELECT event_key, {_DAY} AS version, count(DISTINCT k) AS impacts, max(CASE WHEN value >= 300 THEN 4 WHEN value >= 200 THEN 3 WHEN value >= 80 THEN 2 WHEN value >= 20 THEN 1 ELSE 0 END) AS peak FROM obs GROUP BY ALL)
SELECT event_key, version, impacts, round(least(1.0, 0.7 * (CAST(peak AS DOUBLE) / 4) + 0.3 * least(1.0, CAST(impacts AS DOUBLE) / 5)), 4) AS magnitude FROM v""", obs=True)
def impact_magnitude(t: Tables) -> DataFrame:
    """How grave a day's impacts on an event are together: the worst one's rank and their number."""
    rank = F.when(F.col("value") >= 300, 4).when(F.col("value") >= 200, 3).when(F.col("value") >= 80, 2).when(F.col("value") >= 20, 1).otherwise(0)
    v = t.obs.groupBy("event_key", _day()).agg(F.countDistinct("k").alias("impacts"), F.max(rank).alias("peak"))
    return v.select("event_key", "version", "impacts", delta.breadth_magnitude(F.col("peak"), F.col("impacts")).alias("magnitude"))


#: When the medians by recency are taken, and the half-life of a reading in seconds.
NOW_US, HALF_LIFE_S = 1_706_745_600_000_000, 604_800.0


@query(f""", r AS (SELECT event_key, kind, value, CAST(round(1e9 * CASE kind WHEN 'error' THEN 1.0 WHEN 'purchase' THEN 0.65 ELSE 0.35 END * power(0.5, greatest(0.0, ({NOW_US} - us) / 1e6) / {HALF_LIFE_S})) AS BIGINT) AS w FROM obs WHERE value IS NOT NULL),
c AS (SELECT event_key, kind, value, least(w, greatest(1, sum(w) OVER (PARTITION BY event_key, kind) - w)) AS w FROM r), p AS (SELECT event_key, kind, value, sum(w) AS w FROM c GROUP BY ALL),
q AS (SELECT *, sum(w) OVER (PARTITION BY event_key, kind ORDER BY value ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY event_key, kind) AS t, lead(value) OVER (PARTITION BY event_key, kind ORDER BY value) AS nxt FROM p),
f AS (SELECT * FROM q WHERE 2 * c >= t QUALIFY row_number() OVER (PARTITION BY event_key, kind ORDER BY value) = 1)
SELECT event_key, kind, round(CASE WHEN 2 * c = t AND nxt IS NOT NULL THEN (value + nxt) / 2 ELSE value END, 4) AS weighted_median FROM f""", obs=True)
def recency_median(t: Tables) -> DataFrame:
    """Medians weighed by authority and recency, no reading outweighing the others together."""
    share = F.when(F.col("kind") == "error", 1.0).when(F.col("kind") == "purchase", 0.65).otherwise(0.35)
    age = F.greatest(F.lit(0.0), (F.lit(NOW_US) - F.col("us")) / 1e6)
    rows = t.obs.where("value IS NOT NULL").select("event_key", "kind", "value", F.round(share * 1e9 * F.pow(F.lit(0.5), age / HALF_LIFE_S)).cast("long").alias("w"))
    keys = ["event_key", "kind"]
    return ms.weighted_median(ms.capped_weights(rows, keys, "value", "w"), keys, "value", "w").withColumn("weighted_median", F.round("weighted_median", 4))


#: The registry: a model for each type and brand of parts, trained if it has three parts at least; the first trained brand of a
#: type is its champion, of the others those with an odd version (their greatest size) are challengers.
_MODELS_SQL = """WITH g AS (SELECT p_type || '/' || p_brand AS model_id, p_type AS task, count(*) >= 3 AS trained, max(p_size)::INTEGER AS version FROM part GROUP BY p_type, p_brand),
m AS (SELECT model_id, task, CASE WHEN trained AND model_id = min(model_id) FILTER (trained) OVER (PARTITION BY task) THEN 'champion' WHEN version % 2 = 1 THEN 'challenger' ELSE 'shadow' END AS mode, trained, version FROM g)"""


def models(t: Tables) -> DataFrame:
    g = t.part.groupBy(F.concat_ws("/", "p_type", "p_brand").alias("model_id"), F.col("p_type").alias("task")).agg((F.count(F.lit(1)) >= 3).alias("trained"), F.max("p_size").cast("int").alias("version"))
    first = g.where("trained").groupBy("task").agg(F.min("model_id").alias("first"))
    mode = F.when(F.col("model_id") == F.col("first"), "champion").when(F.col("version") % 2 == 1, "challenger").otherwise("shadow")
    return g.join(first, "task", "left").select("model_id", "task", mode.alias("mode"), "trained", "version")


@query(_MODELS_SQL + " SELECT model_id, task, mode, trained, version, row_number() OVER (PARTITION BY task ORDER BY mode <> 'champion', model_id) AS place FROM m")
def model_listing(t: Tables) -> DataFrame:
    """Registered models by task, champions first."""
    return md.listing(models(t))


@query(_MODELS_SQL + """, w AS (SELECT task, model_id FROM m QUALIFY row_number() OVER (PARTITION BY task ORDER BY version DESC, model_id) = 1), new AS (SELECT w.task, w.model_id FROM w JOIN m USING (model_id) WHERE m.trained)
SELECT m.model_id, m.task, CASE WHEN new.model_id = m.model_id THEN 'champion' WHEN new.model_id IS NOT NULL AND mode = 'champion' THEN 'challenger' ELSE mode END AS mode, trained, version FROM m LEFT JOIN new USING (task)""")
def model_promoted(t: Tables) -> DataFrame:
    """The registry after each task's newest model was put forward as champion; untrained ones are refused."""
    m = models(t)
    newest = m.groupBy("task").agg(F.min(F.struct(-F.col("version"), "model_id")).alias("n")).select(F.col("n.model_id").alias("model_id"), F.lit("champion").alias("mode"))
    return md.promote(m, newest)


@query(_MODELS_SQL + ", s AS (SELECT p_partkey AS key, p_type || '/' || p_brand AS model_id, least(1.0, p_retailprice / 2000.0) AS p FROM part) SELECT task, key, CASE WHEN trained THEN round(CAST(p AS DOUBLE), 6) END AS p, model_id, mode, CASE WHEN trained THEN 'ok' ELSE 'model_required' END AS status FROM s JOIN m USING (model_id)")
def model_outputs(t: Tables) -> DataFrame:
    """Each model's answers for its parts; an untrained one says that it needs training."""
    scored = t.part.select(F.col("p_partkey").alias("key"), F.concat_ws("/", "p_type", "p_brand").alias("model_id"), F.round(F.least(F.lit(1.0), F.col("p_retailprice") / 2000.0), 6).alias("p"))
    return md.outputs(models(t), scored)


PLACES = ("home", "work_site", "school", "gym_hall")


@query(f""", s AS (SELECT source_id, {list(PLACES)}[observation_id % 4 + 1] AS place, max(k) AS top FROM obs GROUP BY ALL), b AS (SELECT * FROM s WHERE top > 0 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY top DESC, place) = 1)
SELECT source_id, format('Your {{}} is the most affected saved place (exposure {{:.2f}}).', replace(place, '_', ' '), top / 100.0) AS detail FROM b""", obs=True)
def saved_place_detail(t: Tables) -> DataFrame:
    """One sentence on each user's most exposed saved place; equal exposures go to the first name."""
    place = F.element_at(F.array(*map(F.lit, PLACES)), (F.col("observation_id") % 4 + 1).cast("int"))
    b = t.obs.where("k > 0").groupBy("source_id").agg(F.min(F.struct((-F.col("k")).alias("low"), place.alias("place"))).alias("b"))
    return b.select("source_id", F.format_string("Your %s is the most affected saved place (exposure %.2f).", F.replace("b.place", F.lit("_"), F.lit(" ")), -F.col("b.low") / 100.0).alias("detail"))


@query(F_SQL + " SELECT event_key, official OR routes > 0 OR authority < 1 AS worth_showing FROM f", obs=True)
def worth_showing(t: Tables) -> DataFrame:
    """Whether an event has an item at or over the floor for interrupting (fixed value 0.35)."""
    return presentation_items(t).groupBy("event_key").agg(F.bool_or((F.col("item") != "quiet") & (F.col("priority") >= 0.35)).alias("worth_showing"))


@query(VERSIONS_SQL + ", l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY version DESC) = 1)" + F_SQL + " SELECT l.event_key, l.version, l.status, l.label, round(CAST(l.authority AS DOUBLE), 6) AS authority, l.n AS run_reports, f.n AS reports, f.sources, f.roads, f.routes, round(f.reliability, 6) AS reliability, f.official FROM l JOIN f USING (event_key)", obs=True)
def event_metrics(t: Tables) -> DataFrame:
    """The measures of each event's latest run beside those of its whole history."""
    last = op.latest(day_versions(t), ["event_key"], ["version"]).select("event_key", "version", "status", "label", F.round("authority", 6).alias("authority"), F.col("n").alias("run_reports"))
    whole = features(t).select("event_key", F.col("n").alias("reports"), "sources", "roads", "routes", F.round("reliability", 6).alias("reliability"), "official")
    return last.join(whole, "event_key")


_DOMAINS = ("road", "transit", "utility", "facility")
_PER_HOUR = "round({n} / greatest(0.1, CASE WHEN h > 0 THEN h ELSE 0.5 END), 2)"


@query(f""", d AS (SELECT event_key, us // 86400000000 AS day, count(*) AS n, min(us) AS first_us, max(us) AS last_us, sum(lon) AS lon, sum(lat) AS lat, min(lon) AS west, min(lat) AS south, sum(k) AS score,
  count(*) FILTER (kind = 'error') AS road, count(*) FILTER (kind = 'purchase') AS transit, count(*) FILTER (kind = 'signup') AS utility, count(*) FILTER (kind NOT IN ('error', 'purchase', 'signup')) AS facility,
  count(*) FILTER (k >= 75) AS immediate, count(*) FILTER (k >= 50 AND k < 75) AS high, count(*) FILTER (k >= 25 AND k < 50) AS moderate, count(*) FILTER (k < 25) AS low, sum(value) AS value, max(value) AS peak,
  bool_or(kind = 'error') AND bool_or(kind = 'signup') AS disputed, arg_min(observation_id, {{'u': us, 'o': observation_id}}) AS fr, arg_max(observation_id, {{'u': us, 'o': observation_id}}) AS lr FROM obs GROUP BY ALL),
p AS (SELECT event_key, sum(n) AS n, min(first_us) AS first_us, max(last_us) AS last_us, sum(lon) / sum(n) AS lon, sum(lat) / sum(n) AS lat, min(west) AS west, min(south) AS south, sum(score) AS score, sum(road) AS road, sum(transit) AS transit, sum(utility) AS utility,
  sum(facility) AS facility, sum(immediate) AS immediate, sum(high) AS high, sum(moderate) AS moderate, sum(low) AS low, sum(value) / sum(n) AS usual, max(peak) AS peak, count(*) AS version, count(*) FILTER (disputed) AS disputed, arg_max(n, day) AS n_now,
  arg_max(value / n, day) AS speed, arg_max(transit, day) AS transit_now, arg_min(fr, day) AS fr, arg_max(lr, day) AS lr FROM d GROUP BY event_key),
s AS (SELECT event_key, count(DISTINCT source_id) AS sources FROM obs GROUP BY event_key),
a AS (SELECT p.*, sources, (last_us - first_us) / 1e6 AS sec, round((last_us - first_us) / 1e6 / 3600, 2) AS h, round(greatest({haversine_sql('lon', 'lat', 'west', 'lat')}, {haversine_sql('lon', 'lat', 'lon', 'south')}), 1) AS radius,
  round(speed / usual, 4) AS ratio, round(((road > 0)::INT + (transit > 0)::INT + (utility > 0)::INT + (facility > 0)::INT) / 4.0, 4)::DOUBLE AS authority, round(least(1.0, sources / 3.0), 4)::DOUBLE AS corroboration,
  round(exp(-({NOW_US} - last_us) / 1e6 / 604800), 4) AS freshness, round(score / n / 100, 4) AS model, round(least(1.0, disputed * 0.2), 4)::DOUBLE AS disagreement FROM p JOIN s USING (event_key)),
b AS (SELECT *, {_PER_HOUR.format(n='n_now')} AS rate, {_PER_HOUR.format(n='((n - n_now) / greatest(1, version - 1))')} AS before,
  CASE WHEN immediate > 0 THEN 'immediate' WHEN high > 0 THEN 'high' WHEN moderate > 0 THEN 'moderate' ELSE 'low' END AS severest FROM a)
SELECT event_key, CASE greatest(road, transit, utility, facility) WHEN facility THEN 'facility' WHEN road THEN 'road' WHEN transit THEN 'transit' ELSE 'utility' END AS event_class, round(greatest(road, transit, utility, facility) / n, 4) AS class_confidence,
 radius AS radius_m, round(radius * radius * pi(), 1) AS footprint_m2, sources::BIGINT AS sources, round(greatest(0.0, 1 - disputed * 0.25), 4)::DOUBLE AS agreement, [road, transit, utility, facility]::BIGINT[] AS by_domain, [immediate, high, moderate, low]::BIGINT[] AS by_severity, severest,
 round(((immediate + high) * 0.85 + (moderate + low) * 0.55) / n, 4)::DOUBLE AS disruption, ratio AS speed_ratio, CASE WHEN ratio < 0.4 THEN 'gridlock' WHEN ratio < 0.6 THEN 'severe' WHEN ratio < 0.75 THEN 'moderate' WHEN ratio < 0.9 THEN 'minor' ELSE 'normal' END AS congestion,
 round(transit_now * 1.5, 1)::DOUBLE AS delay_min, CASE WHEN round(transit_now * 1.5, 1) > 15 THEN 'severe' WHEN round(transit_now * 1.5, 1) > 5 THEN 'moderate' ELSE 'minor' END AS magnitude, round(1 - road / n, 4) AS open_share, version, rate,
 CASE WHEN version = 1 THEN 'steady' WHEN rate > before + 0.5 THEN 'accelerating' WHEN rate < before - 0.5 THEN 'decelerating' ELSE 'steady' END AS trend, round(n / version, 2) AS daily,
 round(1 / (1 + exp(-(-2.6 + 0.6 * least(1.0, road / 4.0) + 0.8 * authority + 0.9 * least(1.0, peak / 1000)))), 4) AS p_road_60,
 round(greatest(0.05, least(1.0, 0.30 * authority + 0.25 * corroboration + 0.15 * freshness + 0.20 * model - 0.10 * disagreement)), 4) AS composite,
 'v' || (version - 1) || '->v' || version AS transition, n_now * 10 >= n AS material, fr AS first_report, lr AS last_report, n || ' reports from ' || sources || ' sources with ' || severest || ' peak severity' AS summary FROM b""", obs=True)
def event_analysis(t: Tables) -> DataFrame:
    """The ten dimensions of each event's analysis, some of each record's fields shown beside each other."""
    rows = t.obs.select(F.col("event_key").alias("event"), F.col("observation_id").alias("report"), F.col("source_id").alias("source"), "us", "lon", "lat", "kind", F.col("k").alias("score"), "value")
    a = mt.analysis(rows, NOW_US)
    listed = lambda m, names: F.array(*(F.col(m)[n] for n in names))
    return a.select(
        F.col("event").alias("event_key"), "situation.event_class", F.col("situation.confidence").alias("class_confidence"), "situation.radius_m", "situation.footprint_m2", "situation.sources", "situation.agreement",
        listed("infrastructure.by_domain", _DOMAINS).alias("by_domain"), listed("infrastructure.by_severity", ("immediate", "high", "moderate", "low")).alias("by_severity"), "infrastructure.severest", "infrastructure.disruption",
        F.col("traffic.ratio").alias("speed_ratio"), "traffic.congestion", "transit.delay_min", "transit.magnitude", "network.open_share", "temporal.version", "temporal.rate", "temporal.trend", "historical.daily",
        "prediction.p_road_60", "confidence.composite", "delta.transition", "delta.material", "provenance.first_report", "provenance.last_report", "provenance.summary",
    )
