"""Aggregations: footprints, evidence, magnitudes, snapshots, evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import measures as ms
from ..operators import ordered as od
from .registry import Tables, haversine_sql, query

# fixed values: weight of each type's authority; the fixture's types stand for the ranks
AUTHORITY = {"view": 0.15, "click": 0.35, "error": 1.0, "purchase": 0.85, "signup": 0.65}
RANKS = {"view": "unverified", "click": "community", "error": "official", "purchase": "semi_official", "signup": "media"}


def lookup(table: dict, key: str):
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col(key)]


def case_sql(table: dict, key: str) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"CASE {key} " + " ".join(f"WHEN '{a}' THEN {quote(b)}" for a, b in table.items()) + " END"


A_SQL = f", a AS (SELECT *, {case_sql(AUTHORITY, 'kind')} AS w FROM obs)"


def weighed(t: Tables) -> DataFrame:
    return t.obs.withColumn("w", lookup(AUTHORITY, "kind"))


@query(A_SQL + " SELECT event_key, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(0.5 * avg(w) + 0.5 * least(1.0, count(*) / 3.0), 6) AS confidence FROM a GROUP BY event_key", obs=True)
def footprint(t: Tables) -> DataFrame:
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return weighed(t).groupBy("event_key").agg(
        r6(F.min("lon"), "min_lon"), r6(F.max("lon"), "max_lon"), r6(F.min("lat"), "min_lat"), r6(F.max("lat"), "max_lat"),
        r6(F.avg("w") * 0.5 + F.least(F.lit(1.0), F.count(F.lit(1)) / 3.0) * 0.5, "confidence"),
    )


@query(f""", e AS (SELECT event_key, min(us) AS u1, max(us) AS u2, arg_min(lon, us::HUGEINT * 1000000000 + observation_id) AS lon1, arg_min(lat, us::HUGEINT * 1000000000 + observation_id) AS lat1, arg_max(lon, us::HUGEINT * 1000000000 + observation_id) AS lon2, arg_max(lat, us::HUGEINT * 1000000000 + observation_id) AS lat2 FROM obs WHERE us < 1706659200000000 GROUP BY event_key),
d AS (SELECT *, (u2 - u1) / 6e7 AS minutes, {haversine_sql('lon1', 'lat1', 'lon2', 'lat2')} AS dist FROM e)
SELECT event_key, round(dist, 2) AS distance_m, round(dist / (minutes * 60), 6) AS speed, minutes >= 0.5 AND dist > greatest(50.0, 10 * minutes) AS moving, round(least(0.9, 0.4 + 0.5 * least(1.0, dist / 1500)), 4) AS confidence FROM d""", obs=True)
def movement(t: Tables) -> DataFrame:
    """First and last place of each event by time: distance, speed, whether it moves."""
    place, order = F.struct("lon", "lat"), F.struct("us", "observation_id")
    e = t.obs.groupBy("event_key").agg(F.min("us").alias("u1"), F.max("us").alias("u2"), F.min_by(place, order).alias("a"), F.max_by(place, order).alias("b"))
    minutes, dist = (F.col("u2") - F.col("u1")) / 6e7, geo.haversine_m(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    return e.select(
        "event_key", F.round(dist, 2).alias("distance_m"), F.round(F.try_divide(dist, minutes * 60), 6).alias("speed"),
        ((minutes >= 0.5) & (dist > F.greatest(F.lit(50.0), minutes * 10))).alias("moving"), F.round(F.least(F.lit(0.9), F.lit(0.4) + F.least(F.lit(1.0), dist / 1500) * 0.5), 4).alias("confidence"),
    )


@query(A_SQL + ", s AS (SELECT event_key, kind, sum(w) AS s FROM a GROUP BY ALL) SELECT event_key, kind, round(s / sum(s) OVER (PARTITION BY event_key), 6) AS share FROM s", obs=True)
def type_distribution(t: Tables) -> DataFrame:
    per = weighed(t).groupBy("event_key", "kind").agg(F.sum("w").alias("s"))
    return per.select("event_key", "kind", F.round(F.col("s") / F.sum("s").over(Window.partitionBy("event_key")), 6).alias("share"))


@query(A_SQL + """, m AS (SELECT max(us) AS now FROM obs), e AS (SELECT event_key, count(*) AS n, count(DISTINCT source_id) AS sources, count(DISTINCT kind) AS kinds, sum(w) AS sw, max(w) AS top, max(us) AS last_us,
 count(DISTINCT CASE WHEN k < 3 THEN k END) AS odd FROM a GROUP BY event_key)
SELECT event_key, n, sources, odd AS contradictions, round(least(1.0, sw / (1.5 * kinds)), 6) AS authority, round(least(1.0, sources / 3.0), 6) AS corroboration, round(greatest(0.0, least(1.0, (7200 - (now - last_us) / 1e6) / 6900)), 6) AS freshness,
round(CAST(greatest(0.2, CASE WHEN sources >= 3 THEN least(0.98, b + 0.15) WHEN sources >= 2 THEN least(0.95, b + 0.10) ELSE b END - 0.12 * odd) AS DOUBLE), 6) AS confidence
FROM (SELECT *, CASE WHEN top >= 1 THEN 0.92 WHEN top >= 0.85 THEN 0.80 WHEN top >= 0.65 THEN 0.68 ELSE 0.40 END AS b FROM e), m""", obs=True)
def evidence_vector(t: Tables) -> DataFrame:
    e = weighed(t).groupBy("event_key").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"), F.countDistinct("kind").alias("kinds"), F.sum("w").alias("sw"), F.max("w").alias("top"), F.max("us").alias("last_us"),
        F.countDistinct(F.when(F.col("k") < 3, F.col("k"))).alias("odd"),
    ).crossJoin(F.broadcast(t.obs.agg(F.max("us").alias("now"))))
    base = F.when(F.col("top") >= 1, 0.92).when(F.col("top") >= 0.85, 0.80).when(F.col("top") >= 0.65, 0.68).otherwise(0.40)
    lifted = F.when(F.col("sources") >= 3, F.least(F.lit(0.98), base + 0.15)).when(F.col("sources") >= 2, F.least(F.lit(0.95), base + 0.10)).otherwise(base)
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return e.select(
        "event_key", "n", "sources", F.col("odd").alias("contradictions"), r6(F.least(F.lit(1.0), F.col("sw") / (F.col("kinds") * 1.5)), "authority"), r6(F.least(F.lit(1.0), F.col("sources") / 3.0), "corroboration"),
        r6(ms.freshness((F.col("now") - F.col("last_us")) / 1e6), "freshness"), r6(F.greatest(F.lit(0.2), lifted - F.col("odd") * 0.12), "confidence"),
    )


@query(A_SQL + """, per AS (SELECT event_key, value, sum(CAST(round(w * 100) AS BIGINT)) AS w FROM a GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY event_key ORDER BY value ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY event_key) AS t, lead(value) OVER (PARTITION BY event_key ORDER BY value) AS nxt FROM per),
f AS (SELECT * FROM c WHERE c >= t / 2 QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY value) = 1)
SELECT event_key, round(CASE WHEN abs(c - t / 2) < 1e-12 AND nxt IS NOT NULL THEN (value + nxt) / 2 ELSE value END, 4) AS weighted_median FROM f""", obs=True)
def weighted_median(t: Tables) -> DataFrame:
    return ms.weighted_median(weighed(t).withColumn("w", F.round(F.col("w") * 100).cast("long")), ["event_key"], "value", "w").withColumn("weighted_median", F.round("weighted_median", 4))


@query(""", g AS (SELECT event_key, us - lag(us) OVER (PARTITION BY event_key ORDER BY us, observation_id) AS gap FROM obs), p AS (SELECT event_key, gap FROM g WHERE gap > 0),
r AS (SELECT event_key, gap, row_number() OVER (PARTITION BY event_key ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY event_key) AS n FROM p)
SELECT event_key, n AS gaps, greatest(300.0, gap / 1e6) AS half_life_s FROM r WHERE i = n // 2""", obs=True)
def half_life(t: Tables) -> DataFrame:
    gaps = od.gaps(t.obs, ["event_key"], "us", "observation_id")
    return ms.upper_median_of(gaps, ["event_key"], "gap").select("event_key", F.col("n").alias("gaps"), F.greatest(F.lit(300.0), F.col("median") / 1e6).alias("half_life_s"))


@query(A_SQL + """, e AS (SELECT event_key, kind AS quantity, count(*) AS n, min(value) AS lo, max(value) AS hi, max(w) AS top, count(DISTINCT source_id) AS s, avg(k) / 100 AS p FROM a GROUP BY ALL), d AS (SELECT *, CASE WHEN abs(hi) > 0 THEN (hi - lo) / abs(hi) ELSE 0 END AS dis FROM e)
SELECT event_key, quantity, round(CASE WHEN n = 1 THEN lo - 0.35 * abs(lo) * greatest(0.2, 1 - p) ELSE lo - 0.1 * (hi - lo) END, 4) AS low, round(CASE WHEN n = 1 THEN hi + 0.35 * abs(hi) * greatest(0.2, 1 - p) ELSE hi + 0.1 * (hi - lo) END, 4) AS high, round(dis, 6) AS disagreement,
round((0.5 * top + 0.2 * least(1.0, 0.6 + 0.1 * s) + 0.3 * p) * (1 - 0.5 * dis), 6) AS confidence FROM d""", obs=True)
def magnitudes(t: Tables) -> DataFrame:
    """Interval, disagreement and confidence of each quantity of an event."""
    e = weighed(t).groupBy("event_key", F.col("kind").alias("quantity")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.max("w").alias("top"), F.countDistinct("source_id").alias("s"), (F.avg("k") / 100).alias("p"))
    lo, hi, one = F.col("lo"), F.col("hi"), F.col("n") == 1
    spread, slack = (hi - lo) * 0.1, F.greatest(F.lit(0.2), 1 - F.col("p")) * 0.35
    dis = F.when(F.abs(hi) > 0, (hi - lo) / F.abs(hi)).otherwise(0.0)
    conf = (F.col("top") * 0.5 + F.least(F.lit(1.0), F.col("s") * 0.1 + 0.6) * 0.2 + F.col("p") * 0.3) * (1 - dis * 0.5)
    return e.select("event_key", "quantity", F.round(F.when(one, lo - F.abs(lo) * slack).otherwise(lo - spread), 4).alias("low"), F.round(F.when(one, hi + F.abs(hi) * slack).otherwise(hi + spread), 4).alias("high"), F.round(dis, 6).alias("disagreement"), F.round(conf, 6).alias("confidence"))


@query(", r AS (SELECT event_key, source_id % 7 AS root, count(*) AS n FROM obs GROUP BY ALL) SELECT event_key, count(*) AS clusters, round(count(*) / sum(n), 6) AS independence, round(sum(1 + 0.2 * sqrt(n - 1)), 6) AS strength FROM r GROUP BY event_key", obs=True)
def corroboration(t: Tables) -> DataFrame:
    """Independent clusters by root source; repeats of a root add with the square root only."""
    r = t.obs.groupBy("event_key", (F.col("source_id") % 7).alias("root")).agg(F.count(F.lit(1)).alias("n"))
    return r.groupBy("event_key").agg(F.count(F.lit(1)).alias("clusters"), F.round(F.count(F.lit(1)) / F.sum("n"), 6).alias("independence"), F.round(F.sum(F.sqrt(F.col("n") - 1) * 0.2 + 1), 6).alias("strength"))


@query(""", e AS (SELECT event_key, max(us) AS last_us, count(*) AS n, max(value) AS peak FROM obs GROUP BY event_key), m AS (SELECT max(us) AS now FROM obs)
SELECT event_key % 4 AS region, count(*) AS events, count(*) FILTER (now - last_us <= 21600000000) AS active, count(*) FILTER (now - last_us > 21600000000 AND now - last_us <= 43200000000) AS quiescent, count(*) FILTER (now - last_us > 43200000000) AS closed, sum(n)::BIGINT AS observations, max(peak) AS peak FROM e, m GROUP BY ALL""", obs=True)
def world_snapshot(t: Tables) -> DataFrame:
    e = t.obs.groupBy("event_key").agg(F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).crossJoin(F.broadcast(t.obs.agg(F.max("us").alias("now"))))
    age, h6 = F.col("now") - F.col("last_us"), 21_600_000_000
    return e.groupBy((F.col("event_key") % 4).alias("region")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(age <= h6).alias("active"), F.count_if((age > h6) & (age <= 2 * h6)).alias("quiescent"), F.count_if(age > 2 * h6).alias("closed"), F.sum("n").alias("observations"), F.max("peak").alias("peak")
    )


@query("SELECT lang AS domain, count(DISTINCT source) AS sources, count(*) FILTER (n_chars > 1000) AS producing, count(*) FILTER (text IS NULL) AS silent FROM documents GROUP BY lang")
def coverage_by_domain(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("lang").alias("domain")).agg(F.countDistinct("source").alias("sources"), F.count_if(F.col("n_chars") > 1000).alias("producing"), F.count_if(F.col("text").isNull()).alias("silent"))


_SCORED_SQL = "WITH s AS (SELECT least(1.0, n_chars / 5000.0) AS p, toxic AS y FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND n_chars IS NOT NULL)"


def scored(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p"))
    return d.join(t.labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").where("y IS NOT NULL AND p IS NOT NULL").select("p", "y")


@query(_SCORED_SQL + """, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM s GROUP BY ALL)
SELECT (SELECT round(avg(power(p - y, 2)), 8) FROM s) AS brier, (SELECT round(sum(n * abs(acc - conf)) / sum(n), 8) FROM b) AS ece, (SELECT count(*) FROM s) AS n""")
def brier_ece(t: Tables) -> DataFrame:
    s = scored(t)
    whole = s.agg(F.round(ms.brier(F.col("p"), F.col("y")), 8).alias("brier"), F.count(F.lit(1)).alias("n"))
    return whole.crossJoin(ms.calibration_error(s, "p", "y").select(F.round("ece", 8).alias("ece"))).select("brier", "ece", "n")


@query(_SCORED_SQL + """, c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM s)
SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 8) AS false_alarm, round(coalesce(fn / nullif(tp + fn, 0), 0), 8) AS missed FROM c""")
def classification_metrics(t: Tables) -> DataFrame:
    c = scored(t).agg(*(v.alias(k) for k, v in ms.confusion(F.col("p"), F.col("y")).items()))
    return c.select("tp", "fp", "fn", "tn", *(F.round(v, 8).alias(k) for k, v in ms.rates(*(F.col(x) for x in ("tp", "fp", "fn", "tn"))).items()))


@query("SELECT l_shipmode, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode, l_extendedprice - l_quantity * 1000 AS e FROM lineitem) GROUP BY l_shipmode")
def regression_metrics(t: Tables) -> DataFrame:
    e = F.col("l_extendedprice") - F.col("l_quantity") * 1000
    return t.lineitem.groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_key, coalesce(max(value) FILTER (kind = 'error'), 0) AS road, coalesce(max(value) FILTER (kind = 'view'), 0) AS transit, coalesce(max(value) FILTER (kind = 'signup'), 0) AS utility FROM obs GROUP BY event_key".join((" ", "")), obs=True)
def domain_scores(t: Tables) -> DataFrame:
    wide = t.obs.groupBy("event_key").pivot("kind", ["error", "view", "signup"]).agg(F.max("value"))
    return wide.select("event_key", F.coalesce("error", F.lit(0.0)).alias("road"), F.coalesce("view", F.lit(0.0)).alias("transit"), F.coalesce("signup", F.lit(0.0)).alias("utility"))


@query(" SELECT event_key AS target, k % 4 AS horizon, max(value) AS probability, arg_max(observation_id, value * 1000000 - observation_id / 1000000.0) AS by_id FROM obs GROUP BY ALL", obs=True)
def forecast_dedupe(t: Tables) -> DataFrame:
    return t.obs.groupBy(F.col("event_key").alias("target"), (F.col("k") % 4).alias("horizon")).agg(F.max("value").alias("probability"), F.max_by("observation_id", F.col("value") * 1000000 - F.col("observation_id") / 1000000.0).alias("by_id"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""")
def pricing_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@query(f", s AS (SELECT event_key, {case_sql(RANKS, 'kind')} AS rank, count(*) AS n, max(us) AS last_us FROM obs GROUP BY ALL) SELECT event_key, string_agg(rank || '=' || n, ',' ORDER BY rank) AS by_rank, arg_max(rank, last_us) AS latest FROM s GROUP BY event_key", obs=True)
def authority_map(t: Tables) -> DataFrame:
    per = t.obs.groupBy("event_key", lookup(RANKS, "kind").alias("rank")).agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("last_us"))
    said = F.concat_ws("=", "rank", F.col("n").cast("string"))
    return per.groupBy("event_key").agg(F.array_join(F.array_sort(F.collect_list(said)), ",").alias("by_rank"), F.max_by("rank", "last_us").alias("latest"))
