"""Scores as expressions: probabilities, priorities, notification gates, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import similarity as sim
from .registry import Tables, query

#: Features of each event, from its reports.
F_SQL = """, f AS (SELECT event_key, count(*) AS n, max(value) AS crowd, count(DISTINCT source_id) AS sources, count(*) FILTER (kind = 'error') AS roads, count(*) FILTER (kind = 'view' AND k < 10) AS routes,
 least(1.0, count(DISTINCT kind) / 5.0) AS authority, avg(k) / 100 AS reliability, bool_or(k = 99 AND kind = 'error') AS official, max(us) AS last_us,
 CASE WHEN hour(max(event_time)) BETWEEN 7 AND 9 OR hour(max(event_time)) BETWEEN 16 AND 18 THEN 1 ELSE 0 END AS rush, (max(us) - min(us)) / 3.6e9 AS hours, CASE WHEN max(lon) - min(lon) > 0.19 THEN 1 ELSE 0 END AS moving FROM obs GROUP BY event_key)"""


def features(t: Tables) -> DataFrame:
    err, hour = F.col("kind") == "error", F.hour(F.max("event_time"))
    return t.obs.groupBy("event_key").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("crowd"), F.countDistinct("source_id").alias("sources"), F.count_if(err).alias("roads"), F.count_if((F.col("kind") == "view") & (F.col("k") < 10)).alias("routes"),
        F.least(F.lit(1.0), F.countDistinct("kind") / 5.0).alias("authority"), (F.avg("k") / 100).alias("reliability"), F.bool_or((F.col("k") == 99) & err).alias("official"), F.max("us").alias("last_us"),
        (hour.between(7, 9) | hour.between(16, 18)).cast("int").alias("rush"), ((F.max("us") - F.min("us")) / 3.6e9).alias("hours"), (F.max("lon") - F.min("lon") > 0.19).cast("int").alias("moving"),
    )


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# fixed values of the horizons' shares and of the impact's targets
HORIZONS = ((5, 0.12), (15, 0.42), (30, 0.72), (60, 1.0))
TARGETS = ("road", "transit", "utility", "facility", "route_delay")


@query(F_SQL + """, z AS (SELECT *, -2.6 + 0.55 * moving + 0.9 * least(1.0, crowd / 1000) + 0.7 * least(1.0, n / 500.0) + 1.4 * CASE WHEN official THEN 1 ELSE 0 END + 0.6 * least(1.0, roads / 4.0) + 0.8 * least(1.0, routes / 3.0)
  + 0.35 * least(1.0, hours / 24) + 0.3 * rush + 0.8 * authority + 0.5 * least(1.0, sources / 20.0) - 0.7 * reliability AS x FROM f),
y AS (SELECT event_key, target, x + CASE target WHEN 'road' THEN 0 WHEN 'transit' THEN -0.35 * routes WHEN 'utility' THEN -2.4 WHEN 'facility' THEN -2.0 ELSE 0.3 * rush END AS x FROM z, (VALUES ('road'), ('transit'), ('utility'), ('facility'), ('route_delay')) v(target))
SELECT event_key, target, horizon, round(CAST(share / (1 + exp(-x)) AS DOUBLE), 6) AS p FROM y, (VALUES (5, 0.12), (15, 0.42), (30, 0.72), (60, 1.0)) h(horizon, share)""", obs=True)
def logit_impact(t: Tables) -> DataFrame:
    """Probability of impact by five targets and four horizons (fixed values: the weights and shifts)."""
    f = features(t)
    full = lambda c, most: F.least(F.lit(1.0), F.col(c) / most)
    x = (
        F.col("moving") * 0.55 - 2.6 + full("crowd", 1000) * 0.9 + full("n", 500.0) * 0.7 + F.col("official").cast("int") * 1.4 + full("roads", 4.0) * 0.6 + full("routes", 3.0) * 0.8
        + full("hours", 24) * 0.35 + F.col("rush") * 0.3 + F.col("authority") * 0.8 + full("sources", 20.0) * 0.5 - F.col("reliability") * 0.7
    )
    shifts = {"road": F.lit(0.0), "transit": F.col("routes") * -0.35, "utility": F.lit(-2.4), "facility": F.lit(-2.0), "route_delay": F.col("rush") * 0.3}
    targets = F.array(*(F.struct(F.lit(n).alias("target"), shifts[n].cast("double").alias("shift")) for n in TARGETS))
    horizons = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(s).alias("share")) for h, s in HORIZONS))
    rows = f.select("event_key", x.alias("x"), F.explode(targets).alias("t")).select("event_key", "x", "t", F.explode(horizons).alias("h"))
    return rows.select("event_key", "t.target", "h.horizon", r6(F.col("h.share") * tx.sigmoid(F.col("x") + F.col("t.shift")), "p"))


@query(F_SQL + ", h AS (SELECT event_key, target, base * (1 + 4 * reliability) AS hz FROM f, (VALUES ('road', 0.010), ('transit', 0.006), ('utility', 0.002), ('facility', 0.003)) v(target, base)) SELECT event_key, target, round(ln(2) / hz, 4) AS median_min, round(1 - exp(-hz * 30), 6) AS p_30 FROM h", obs=True)
def hazard_horizons(t: Tables) -> DataFrame:
    """Exponential hazard by target: median minutes to impact and probability within half an hour."""
    bases = F.array(*(F.struct(F.lit(n).alias("target"), F.lit(b).alias("base")) for n, b in (("road", 0.010), ("transit", 0.006), ("utility", 0.002), ("facility", 0.003))))
    rows = features(t).select("event_key", "reliability", F.explode(bases).alias("b"))
    hz = F.col("b.base") * (F.col("reliability") * 4 + 1)
    return rows.select("event_key", "b.target", F.round(F.lit(0.6931471805599453) / hz, 4).alias("median_min"), r6(1 - F.exp(-hz * 30), "p_30"))


@query(F_SQL + " SELECT event_key, round(greatest(crowd / 10, 5 * least(3, routes) + CASE WHEN roads > 0 THEN 8 ELSE 0 END), 4) AS delay_min, round(least(0.95, 0.05 + CASE WHEN roads > 0 THEN 0.2 ELSE 0 END + 0.12 * least(3, routes)), 6)::DOUBLE AS cancel FROM f", obs=True)
def transit_disruption(t: Tables) -> DataFrame:
    shut, few = F.col("roads") > 0, F.least(F.lit(3), F.col("routes"))
    delay = F.greatest(F.col("crowd") / 10, few * 5 + F.when(shut, 8).otherwise(0))
    return features(t).select("event_key", F.round(delay, 4).alias("delay_min"), r6(F.least(F.lit(0.95), F.when(shut, 0.25).otherwise(0.05) + few * 0.12), "cancel"))


# fixed values: expected flow by weekday or weekend and period
BASELINE = {"weekday_morning": 0.85, "weekday_midday": 0.5, "weekday_evening": 0.9, "weekday_night": 0.45, "weekend_morning": 0.4, "weekend_midday": 0.35, "weekend_evening": 0.5, "weekend_night": 0.3}


@query(", h AS (SELECT observation_id, value / 100 AS flow, (CASE WHEN isodow(event_time) >= 6 THEN 'weekend_' ELSE 'weekday_' END) || CASE WHEN hour(event_time) BETWEEN 6 AND 9 THEN 'morning' WHEN hour(event_time) BETWEEN 11 AND 13 THEN 'midday' WHEN hour(event_time) BETWEEN 14 AND 19 THEN 'evening' ELSE 'night' END AS period FROM obs), b AS (SELECT *, flow / CASE period " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in BASELINE.items()) + " END AS ratio FROM h) SELECT observation_id, period, round(ratio, 6) AS ratio, CASE WHEN ratio < 0.4 THEN 'gridlock' WHEN ratio < 0.6 THEN 'severe' WHEN ratio < 0.75 THEN 'moderate' WHEN ratio < 0.9 THEN 'minor' ELSE 'normal' END AS band FROM b", obs=True)
def traffic_anomaly(t: Tables) -> DataFrame:
    """Observed flow against the period's baseline, as a ratio and a band."""
    at = F.col("event_time")
    hour = F.hour(at)
    part = F.when(hour.between(6, 9), "morning").when(hour.between(11, 13), "midday").when(hour.between(14, 19), "evening").otherwise("night")
    period = F.concat(F.when(F.weekday(at) >= 5, "weekend_").otherwise("weekday_"), part)
    table = F.create_map(*(F.lit(x) for kv in BASELINE.items() for x in kv))
    rows = t.obs.select("observation_id", (F.col("value") / 100).alias("flow"), period.alias("period"))
    ratio = F.col("flow") / table[F.col("period")]
    return rows.select("observation_id", "period", r6(ratio, "ratio"), tx.ladder(ratio, [(0.9, "normal"), (0.75, "minor"), (0.6, "moderate"), (0.4, "severe")], "gridlock").alias("band"))


@query(", l AS (SELECT event_key, us // 86400000000 AS day, sum(ln((0.3 + k / 200.0) / (1 - 0.3 - k / 200.0))) AS s FROM obs GROUP BY ALL) SELECT event_key, day, round(greatest(0.01, least(0.99, 1 / (1 + exp(-(ln(0.2 / 0.8) + s))))), 6) AS p FROM l", obs=True)
def bayes_fusion(t: Tables) -> DataFrame:
    """Log-odds fusion of the independent reports of an event and day on a prior of 0.2."""
    q = F.col("k") / 200.0 + 0.3
    s = t.obs.groupBy("event_key", F.floor(F.col("us") / 86_400_000_000).cast("long").alias("day")).agg(F.sum(F.log(q / (1 - F.lit(0.3) - F.col("k") / 200.0))).alias("s"))
    return s.select("event_key", "day", r6(tx.clamp(tx.sigmoid(F.col("s") + F.log(F.lit(0.2) / 0.8)), 0.01, 0.99), "p"))


@query(" SELECT source_id, round((7.0 + count(*) FILTER (kind <> 'error')) / (10.0 + count(*)), 6) AS reliability FROM obs GROUP BY source_id", obs=True)
def beta_reliability(t: Tables) -> DataFrame:
    """Posterior mean of a source's reliability with a (7, 3) prior."""
    return t.obs.groupBy("source_id").agg(r6((F.count_if(F.col("kind") != "error") + 7.0) / (F.count(F.lit(1)) + 10.0), "reliability"))


@query(F_SQL + " SELECT event_key, round(greatest(0.05, least(1.0, 0.45 * authority + 0.35 * least(1.0, sources / 3.0) + 0.2 * reliability - least(0.3, 0.1 * roads % 4) - 0.08 * (n % 3))), 6) AS confidence FROM f".replace("0.1 * roads % 4", "0.1 * (roads % 4)"), obs=True)
def source_conflict(t: Tables) -> DataFrame:
    blend = F.col("authority") * 0.45 + F.least(F.lit(1.0), F.col("sources") / 3.0) * 0.35 + F.col("reliability") * 0.2 - F.least(F.lit(0.3), (F.col("roads") % 4) * 0.1) - (F.col("n") % 3) * 0.08
    return features(t).select("event_key", r6(tx.clamp(blend, 0.05, 1.0), "confidence"))


@query(F_SQL + ", c AS (SELECT *, 0.7 * least(1.0, crowd / 500) + 0.3 * least(1.0, roads / 6.0) AS impact, least(1.0, 0.2 + routes / 20.0) AS exposure, least(1.0, 0.1 + n / 300.0) AS urgency FROM f) SELECT event_key, round(CASE WHEN official THEN greatest(0.9, power(impact * exposure * urgency * authority * reliability, 0.2)) ELSE power(impact * exposure * urgency * authority * reliability, 0.2) END, 6) AS priority FROM c", obs=True)
def priority_geomean(t: Tables) -> DataFrame:
    """Fifth root of the five factors; official guidance lifts it to 0.9."""
    impact = F.least(F.lit(1.0), F.col("crowd") / 500) * 0.7 + F.least(F.lit(1.0), F.col("roads") / 6.0) * 0.3
    product = impact * F.least(F.lit(1.0), F.col("routes") / 20.0 + 0.2) * F.least(F.lit(1.0), F.col("n") / 300.0 + 0.1) * F.col("authority") * F.col("reliability")
    p = F.pow(product, 0.2)
    return features(t).select("event_key", r6(F.when(F.col("official"), F.greatest(F.lit(0.9), p)).otherwise(p), "priority"))


@query(" SELECT observation_id, CASE WHEN score >= 0.72 THEN 'critical' WHEN score >= 0.48 THEN 'high' WHEN score >= 0.26 THEN 'moderate' WHEN score >= 0.02 THEN 'low' ELSE 'none' END AS band, CASE WHEN score < 0.1 THEN 'below_minimum' WHEN (hour(event_time) >= 22 OR hour(event_time) < 6) AND NOT (kind = 'error' AND score >= 0.2) THEN 'quiet_hours' WHEN repeat THEN 'duplicate' ELSE 'send' END AS gate FROM (SELECT *, k / 100.0 AS score, row_number() OVER (PARTITION BY source_id, k, us // 86400000000 ORDER BY us, observation_id) > 1 AS repeat FROM obs)", obs=True)
def notification_gates(t: Tables) -> DataFrame:
    """Exposure band and the first gate that refuses: minimum, quiet hours (official passes), duplicate of the day."""
    score, hour = F.col("k") / 100.0, F.hour("event_time")
    by = Window.partitionBy("source_id", "k", F.floor(F.col("us") / 86_400_000_000)).orderBy("us", "observation_id")
    rows = t.obs.withColumn("repeat", F.row_number().over(by) > 1)
    quiet = ((hour >= 22) | (hour < 6)) & ~((F.col("kind") == "error") & (score >= 0.2))
    band = tx.ladder(score, [(0.72, "critical"), (0.48, "high"), (0.26, "moderate"), (0.02, "low")], "none")
    return rows.select("observation_id", band.alias("band"), F.when(score < 0.1, "below_minimum").when(quiet, "quiet_hours").when(F.col("repeat"), "duplicate").otherwise("send").alias("gate"))


_W = (0.25, 0.15, 0.25, 0.15, 0.10, 0.10)


@query("WITH v AS (SELECT vec_id, label, list_transform(range(1, 7), lambda j: list_avg(list_transform(embedding[j:len(embedding):6], lambda x: CAST(x AS DOUBLE)))) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0), d AS (SELECT q.vec_id AS query, v.vec_id, v.label, round(" + " + ".join(f"{w} * abs(q.e[{i + 1}] - v.e[{i + 1}])" for i, w in enumerate(_W)) + ", 9) AS dist FROM q, v WHERE v.vec_id <> q.vec_id) SELECT query, vec_id, label, dist FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, vec_id) <= 3")
def knn_l1(t: Tables) -> DataFrame:
    """Three nearest analogues of each target by weighted L1 distance over six features, each the mean of every sixth component:
    a stated target set against the whole library."""
    every = [F.filter("embedding", (lambda j: lambda x, i: i % 6 == j)(j)) for j in range(6)]
    e = [F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(x) for x in every]
    v = t.embeddings.select("vec_id", "label", F.array(*e).alias("e"))
    targets = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("e").alias("qe"))
    out = sim.nearest(targets, v, "query", "vec_id", sim.weighted_l1(F.col("qe"), F.col("e"), _W), 3, digits=9, same=["e"])
    return out.select("query", "vec_id", "label", "dist")


@query(F_SQL + ", s AS (SELECT event_key, cap, round(CASE cap WHEN 'geospatial' THEN greatest(0.2, authority * reliability) WHEN 'prediction' THEN least(1.0, crowd / 400) * reliability WHEN 'graph' THEN CASE WHEN reliability < 0.5 THEN 0.25 ELSE 1 END * least(1.0, roads / 40.0) ELSE least(1.0, routes / 10.0) END, 6) AS score FROM f, (VALUES ('geospatial'), ('prediction'), ('graph'), ('similarity')) c(cap)) SELECT event_key, cap, score, row_number() OVER (PARTITION BY event_key ORDER BY score DESC, cap) AS rank FROM s WHERE score >= 0.05 QUALIFY rank <= 2", obs=True)
def relevance_topk(t: Tables) -> DataFrame:
    """The two most relevant analyses of each event above the floor."""
    name = F.col("cap")
    score = (
        F.when(name == "geospatial", F.greatest(F.lit(0.2), F.col("authority") * F.col("reliability"))).when(name == "prediction", F.least(F.lit(1.0), F.col("crowd") / 400) * F.col("reliability"))
        .when(name == "graph", F.when(F.col("reliability") < 0.5, 0.25).otherwise(1.0) * F.least(F.lit(1.0), F.col("roads") / 40.0)).otherwise(F.least(F.lit(1.0), F.col("routes") / 10.0))
    )
    rows = features(t).withColumn("cap", F.explode(F.array(*map(F.lit, ("geospatial", "prediction", "graph", "similarity"))))).select("event_key", "cap", r6(score, "score")).where("score >= 0.05")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("event_key").orderBy(F.desc("score"), "cap")).cast("long")).where("rank <= 2")


@query(F_SQL + " SELECT event_key, round(greatest(0.05, least(1.0, 0.30 * authority + 0.25 * least(1.0, sources / 3.0) + 0.15 * reliability + 0.20 * least(1.0, n / 200.0) - 0.10 * least(1.0, roads / 100.0))), 6) AS confidence, round((roads * 1 + routes * 0.7 + (n - roads - routes) * 0.35) / n, 6)::DOUBLE AS truth FROM f", obs=True)
def composite_confidence(t: Tables) -> DataFrame:
    blend = F.col("authority") * 0.30 + F.least(F.lit(1.0), F.col("sources") / 3.0) * 0.25 + F.col("reliability") * 0.15 + F.least(F.lit(1.0), F.col("n") / 200.0) * 0.20 - F.least(F.lit(1.0), F.col("roads") / 100.0) * 0.10
    truth = (F.col("roads") + F.col("routes") * 0.7 + (F.col("n") - F.col("roads") - F.col("routes")) * 0.35) / F.col("n")
    return features(t).select("event_key", r6(tx.clamp(blend, 0.05, 1.0), "confidence"), r6(truth, "truth"))


@query(F_SQL + """, i AS (SELECT event_key, 'guidance' AS item, CAST(1.0 AS DOUBLE) AS p FROM f WHERE official UNION ALL SELECT event_key, 'route', least(0.99, 0.7 + 0.3 * reliability) FROM f WHERE routes > 0 UNION ALL SELECT event_key, 'evidence', 0.2 FROM f UNION ALL SELECT event_key, 'uncertainty', 0.35 FROM f WHERE authority < 1)
SELECT event_key, item, round(CAST(p AS DOUBLE), 6) AS priority, row_number() OVER (PARTITION BY event_key ORDER BY round(CAST(p AS DOUBLE), 6) DESC, item) AS rank FROM i""", obs=True)
def presentation_items(t: Tables) -> DataFrame:
    """Items shown for each event, ranked: one scan builds all kinds as an array of optional rows."""
    item = lambda when, name, p: F.when(when, F.struct(F.lit(name).alias("item"), F.round(p, 6).alias("priority")))
    every = F.array_compact(F.array(item(F.col("official"), "guidance", F.lit(1.0)), item(F.col("routes") > 0, "route", F.least(F.lit(0.99), F.col("reliability") * 0.3 + 0.7)), item(F.lit(True), "evidence", F.lit(0.2)), item(F.col("authority") < 1, "uncertainty", F.lit(0.35))))
    rows = features(t).select("event_key", F.explode(every).alias("i")).select("event_key", "i.item", "i.priority")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("event_key").orderBy(F.desc("priority"), "item")).cast("long"))
