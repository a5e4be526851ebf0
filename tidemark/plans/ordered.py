"""Ordered analytics: buckets, sessions, silence, rates, trends, point-in-time data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import feedback as fb
from ..operators import measures as ms
from ..operators import ordered as od
from .registry import Tables, query


@query(" SELECT kind, us // 900000000 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM obs GROUP BY ALL", obs=True)
def bucket_15m(t: Tables) -> DataFrame:
    return t.obs.groupBy("kind", F.floor(F.col("us") / 900_000_000).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(" SELECT observation_id, count(*) OVER (PARTITION BY source_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_hour FROM obs", obs=True)
def sliding_1h(t: Tables) -> DataFrame:
    by = Window.partitionBy("source_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return t.obs.select("observation_id", F.count(F.lit(1)).over(by).alias("in_hour"))


@query(""", g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 7200000000 THEN 1 ELSE 0 END AS o FROM obs WINDOW w AS (PARTITION BY source_id ORDER BY us, observation_id)),
s AS (SELECT source_id, us, sum(o) OVER (PARTITION BY source_id ORDER BY us, observation_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT source_id, session::BIGINT AS session, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM s GROUP BY ALL""", obs=True)
def session_gap_120m(t: Tables) -> DataFrame:
    rows = od.sessions(t.obs.select("source_id", "us", "observation_id"), ["source_id"], "us", "observation_id", 7_200_000_000)
    return rows.groupBy("source_id", F.col("session").cast("long").alias("session")).agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


@query(""", g AS (SELECT source_id, us - lag(us) OVER (PARTITION BY source_id ORDER BY us, observation_id) AS gap FROM obs), p AS (SELECT * FROM g WHERE gap > 0), r AS (SELECT source_id, gap, row_number() OVER (PARTITION BY source_id ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS m FROM p),
d AS (SELECT source_id, gap / 1e6 AS med, m FROM r WHERE i = m // 2), e AS (SELECT source_id, count(*) AS n, max(us) AS last_us, bool_or(k = 99) AS resolved, bool_or(kind = 'error') AS had FROM obs GROUP BY source_id), now AS (SELECT max(us) AS now FROM obs),
f AS (SELECT e.source_id, n, (now - last_us) / 1e6 AS silence, resolved, had, CASE WHEN coalesce(m, 0) >= 2 AND n >= 3 THEN greatest(900.0, least(21600.0, 8 * med)) ELSE 21600.0 END AS threshold FROM e LEFT JOIN d USING (source_id), now)
SELECT source_id, round(silence, 3) AS silence_s, round(threshold, 3) AS threshold_s, CASE WHEN resolved AND NOT had THEN 'closed:resolution_record' WHEN n >= 3 AND silence >= 2 * threshold THEN 'closed:silence' WHEN silence >= threshold THEN 'quiescent' ELSE 'active' END AS status FROM f""", obs=True)
def silence_lifecycle(t: Tables) -> DataFrame:
    med = ms.upper_median_of(od.gaps(t.obs, ["source_id"], "us", "observation_id"), ["source_id"], "gap").select("source_id", (F.col("median") / 1e6).alias("med"), F.col("n").alias("m"))
    e = t.obs.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("last_us"), F.bool_or(F.col("k") == 99).alias("resolved"), F.bool_or(F.col("kind") == "error").alias("had"))
    rows = e.join(med, "source_id", "left").crossJoin(F.broadcast(t.obs.agg(F.max("us").alias("now"))))
    silence = (F.col("now") - F.col("last_us")) / 1e6
    threshold = od.silence_threshold(F.col("med"), F.coalesce("m", F.lit(0)), F.col("n"))
    return rows.select("source_id", F.round(silence, 3).alias("silence_s"), F.round(threshold, 3).alias("threshold_s"), od.lifecycle(silence, threshold, F.col("n"), F.col("resolved"), F.col("had")).alias("status"))


@query(""", e AS (SELECT source_id, min(us) AS a, max(us) AS b, count(*) AS n FROM obs GROUP BY source_id), h AS (SELECT e.source_id, n, b - a AS span, count(*) FILTER (us * 2 < a + b) AS early, count(*) FILTER (us * 2 >= a + b) AS late FROM obs JOIN e USING (source_id) GROUP BY ALL),
r AS (SELECT *, CASE WHEN early > 0 THEN late / early WHEN late > 0 THEN 2.0 ELSE 1.0 END AS ratio FROM h)
SELECT source_id, round((n - 1) / (span / 3.6e9), 4) AS per_hour, CASE WHEN ratio >= 1.5 THEN 'rising' WHEN ratio <= 0.67 THEN 'falling' ELSE 'steady' END AS trend, round(least(1.0, CASE WHEN ratio >= 1.5 THEN (ratio - 1) / 2 WHEN ratio <= 0.67 THEN (1 / greatest(ratio, 1e-6) - 1) / 2 ELSE abs(ratio - 1) END), 4) AS strength FROM r WHERE span > 0""", obs=True)
def rate_trend(t: Tables) -> DataFrame:
    ends = t.obs.groupBy("source_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    rows = t.obs.select("source_id", "us").join(ends, "source_id")
    early = F.col("us") * 2 < F.col("a") + F.col("b")
    h = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("b") - F.col("a")).alias("span"), F.count_if(early).alias("early"), F.count_if(~early).alias("late")).where("span > 0")
    label, strength = od.trend(F.col("early"), F.col("late"))
    return h.select("source_id", F.round((F.col("n") - 1) / (F.col("span") / 3.6e9), 4).alias("per_hour"), label.alias("trend"), F.round(strength, 4).alias("strength"))


@query(" SELECT source_id, count(*) AS n, round(regr_slope(value, (us - 1704067200000000) / 1e6) * 3600, 6) AS slope_per_hour FROM obs GROUP BY source_id HAVING count(*) >= 3", obs=True)
def ols_slope(t: Tables) -> DataFrame:
    x = (F.col("us") - 1_704_067_200_000_000) / 1e6
    return t.obs.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("value", x) * 3600, 6).alias("slope_per_hour")).where("n >= 3")


@query(""", r AS (SELECT source_id, us, value, row_number() OVER (PARTITION BY source_id ORDER BY us, observation_id) AS i, count(*) OVER (PARTITION BY source_id) AS n FROM obs), h AS (SELECT source_id, sum(CAST(round(value * 100) AS BIGINT)) FILTER (i <= n // 2) / (100 * (max(n) // 2)) AS a, sum(CAST(round(value * 100) AS BIGINT)) FILTER (i > n // 2) / (100 * (max(n) - max(n) // 2)) AS b FROM r GROUP BY source_id HAVING max(n) >= 4)
SELECT source_id, round(a, 4) AS before, round(b, 4) AS after, CASE WHEN b > 1.25 * a THEN 'accelerating' WHEN b < 0.8 * a THEN 'decelerating' ELSE 'steady' END AS regime FROM h""", obs=True)
def regime_split(t: Tables) -> DataFrame:
    by = Window.partitionBy("source_id")
    r = t.obs.select("source_id", "value", F.row_number().over(by.orderBy("us", "observation_id")).alias("i"), F.count(F.lit(1)).over(by).alias("n")).where("n >= 4")
    first = F.col("i") <= F.floor(F.col("n") / 2)
    half, cents = F.floor(F.col("n") / 2), F.round(F.col("value") * 100).cast("long")
    sums = r.groupBy("source_id", "n").agg(F.sum(F.when(first, cents)).alias("x"), F.sum(F.when(~first, cents)).alias("y"))
    h = sums.select("source_id", (F.col("x") / (half * 100)).alias("a"), (F.col("y") / ((F.col("n") - half) * 100)).alias("b"))
    regime = F.when(F.col("b") > F.col("a") * 1.25, "accelerating").when(F.col("b") < F.col("a") * 0.8, "decelerating").otherwise("steady")
    return h.select("source_id", F.round("a", 4).alias("before"), F.round("b", 4).alias("after"), regime.alias("regime"))


_PIT = """, p AS (SELECT observation_id, event_key, us, value, kind, k FROM obs)"""


@query(_PIT + """ SELECT observation_id, count(*) OVER w AS seen, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cents, count(*) FILTER (kind = 'error') OVER w AS errors, count(*) OVER (PARTITION BY event_key ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_day FROM p
WINDOW w AS (PARTITION BY event_key ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", obs=True)
def pit_features(t: Tables) -> DataFrame:
    """What was known of the event at each observation, nothing later."""
    rows = t.obs.select("event_key", "us", F.lit(1).cast("long").alias("seen"), F.round(F.col("value") * 100).cast("long").alias("cents"), (F.col("kind") == "error").cast("long").alias("errors"))
    at = F.explode(F.array(F.struct(F.lit(True).alias("now"), F.col("us").alias("at")), F.struct(F.lit(False).alias("now"), (F.col("us") - 86_400_000_001).alias("at"))))
    points = t.obs.select("event_key", "observation_id", at.alias("p")).select("event_key", "observation_id", "p.now", "p.at")
    c = od.counted_at(rows, points, "event_key", "us", ["seen", "cents", "errors"])
    of = lambda name: F.max(F.when(F.col("now"), F.col(name)))
    return c.groupBy("observation_id").agg(*(of(n).alias(n) for n in ("seen", "cents", "errors")), (of("seen") - F.max(F.when(~F.col("now"), F.col("seen")))).alias("in_day"))


@query(_PIT + " SELECT observation_id, " + ", ".join(f"coalesce(max(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY event_key ORDER BY us RANGE BETWEEN 1 FOLLOWING AND {h * 60_000_000} FOLLOWING), 0) AS in_{h}" for h in (5, 15, 30, 60)) + " FROM p", obs=True)
def pit_outcomes(t: Tables) -> DataFrame:
    """Whether a disruption follows within each horizon, strictly after the observation."""
    horizons = (5, 15, 30, 60)
    at = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), (F.col("us") + h * 60_000_000).alias("at")) for h in (0, *horizons))))
    points = t.obs.select("event_key", "observation_id", at.alias("p")).select("event_key", "observation_id", "p.h", "p.at")
    c = od.counted_at(t.obs.select("event_key", "us", (F.col("kind") == "error").cast("long").alias("hits")), points, "event_key", "us", ["hits"])
    of = lambda h: F.max(F.when(F.col("h") == h, F.col("hits")))
    return c.groupBy("observation_id").agg(*((of(h) > of(0)).cast("int").alias(f"in_{h}") for h in horizons))


@query(""", e AS (SELECT source_id, min(us) AS a, max(us) AS b FROM obs GROUP BY source_id), g AS (SELECT source_id, a + i * 86400000000 AS at FROM e, range(0, 40) r(i) WHERE a + i * 86400000000 <= b)
SELECT g.source_id, g.at, count(*) FILTER (o.us <= g.at) AS known, count(*) FILTER (o.us > g.at AND o.us <= g.at + 3600000000) AS next_hour FROM g JOIN obs o USING (source_id) GROUP BY ALL""", obs=True)
def pit_grid(t: Tables) -> DataFrame:
    """A daily sample grid over each source's span, with counts known at the time and in the hour after it (its SQL's grid)."""
    return od.grid_counts(t.obs.select("source_id", "us"), "source_id", "us", 86_400_000_000, {"next_hour": 3_600_000_000})


@query(""", e AS (SELECT source_id, min(us) AS a, max(us) AS b FROM obs GROUP BY source_id), g AS (SELECT source_id, unnest(range(a, b + 1, 900000000)) AS at FROM e)
SELECT g.source_id, g.at, count(*) FILTER (o.us <= g.at) AS known, """ + ", ".join(f"count(*) FILTER (o.us > g.at AND o.us <= g.at + {h * 60_000_000}) AS next_{h}" for h in (5, 15, 30, 60)) + " FROM g JOIN obs o USING (source_id) GROUP BY ALL", obs=True)
def pit_grid_15m(t: Tables) -> DataFrame:
    """The reference's training grid: every 15 minutes to each source's end, with outcomes at 5, 15, 30 and 60 minutes."""
    return od.grid_counts(t.obs.select("source_id", "us"), "source_id", "us", 900_000_000, {f"next_{h}": h * 60_000_000 for h in (5, 15, 30, 60)})


@query(""", s AS (SELECT source_id, us // 86400000000 AS day, CASE WHEN count(*) >= 4 THEN 'active' WHEN count(*) >= 2 THEN 'quiescent' ELSE 'closed' END AS status FROM obs GROUP BY ALL), l AS (SELECT *, lag(status) OVER (PARTITION BY source_id ORDER BY day) AS before FROM s)
SELECT source_id, day, before, status FROM l WHERE before IS NULL OR before <> status""", obs=True)
def lifecycle_transitions(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    s = t.obs.groupBy("source_id", F.floor(F.col("us") / 86_400_000_000).cast("long").alias("day")).agg(F.when(n >= 4, "active").when(n >= 2, "quiescent").otherwise("closed").alias("status"))
    l = s.withColumn("before", F.lag("status").over(Window.partitionBy("source_id").orderBy("day")))
    return l.where("before IS NULL OR before <> status").select("source_id", "day", "before", "status")


@query(" SELECT observation_id, us - max(us) OVER (PARTITION BY source_id ORDER BY us RANGE BETWEEN 7200000000 PRECEDING AND 1 PRECEDING) AS since_us, count(*) OVER (PARTITION BY source_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) < 5 AS allowed FROM obs", obs=True)
def rate_limit_window(t: Tables) -> DataFrame:
    """Alerts with the time since the last one in the repeat window, and whether the trailing limit allows them."""
    key = Window.partitionBy("source_id").orderBy("us")
    rows = t.obs
    return rows.select("observation_id", (F.col("us") - F.max("us").over(key.rangeBetween(-7_200_000_000, -1))).alias("since_us"), (F.count(F.lit(1)).over(key.rangeBetween(-86_400_000_000, -1)) < 5).alias("allowed"))


_ALERT_WINDOWS = (3, 86_400_000_000, 3 * 86_400_000_000, 7 * 86_400_000_000)


@query(""", c AS (SELECT observation_id, source_id, us, k // 10 AS ev, kind || k AS key, CASE kind WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS rank, k >= 95 AS official, row_number() OVER (PARTITION BY source_id ORDER BY us, observation_id) AS i FROM obs)
, steps AS (WITH RECURSIVE r AS (SELECT source_id, 0::BIGINT AS i, NULL::BIGINT AS observation_id, '' AS decision, [{'us': 0::BIGINT, 'ev': 0::BIGINT, 'key': '', 'rank': 0}][1:0] AS sent FROM (SELECT DISTINCT source_id FROM c)
 UNION ALL SELECT source_id, i, observation_id, decision, CASE WHEN decision IN ('sent', 'official_bypass') THEN list_append(sent, {'us': us, 'ev': ev, 'key': key, 'rank': rank}) ELSE sent END FROM (
  SELECT c.source_id, c.i, c.observation_id, c.us, c.ev, c.key, c.rank, r.sent,
   CASE WHEN len(list_filter(r.sent, lambda x: x.key = c.key AND x.us >= c.us - 604800000000)) > 0 THEN 'duplicate_dedupe_key'
    WHEN c.official THEN 'official_bypass'
    WHEN coalesce(list_filter(r.sent, lambda x: x.ev = c.ev AND x.us >= c.us - 259200000000)[-1].rank >= c.rank, false) THEN 'equivalent_recent_alert'
    WHEN len(list_filter(r.sent, lambda x: x.us >= c.us - 86400000000)) >= 3 THEN 'rate_limited' ELSE 'sent' END AS decision
  FROM r JOIN c ON c.source_id = r.source_id AND c.i = r.i + 1)) SELECT * FROM r)
SELECT observation_id, source_id, decision FROM steps WHERE i > 0""", obs=True)
def rate_limit_feedback(t: Tables) -> DataFrame:
    """Alerts refused as duplicates, as repeats that are not more urgent, or beyond three a day, where only sent alerts count."""
    rank = F.when(F.col("kind") == "error", 3).when(F.col("kind") == "purchase", 2).when(F.col("kind") == "signup", 1).otherwise(0)
    rows = t.obs.select(
        F.col("observation_id").alias("alert_id"), F.col("source_id").alias("user_id"), "us", F.floor(F.col("k") / 10).alias("event_id"), F.concat("kind", "k").alias("dedupe_key"),
        rank.alias("urgency"), (F.col("k") >= 95).alias("official"),
    )
    return fb.sent_alerts(rows, *_ALERT_WINDOWS).withColumnsRenamed({"alert_id": "observation_id", "user_id": "source_id"})


@query()
def regime_change_points(t: Tables) -> DataFrame:
    """Change points of each source's daily totals (optimal segmentation; no SQL form)."""
    daily = t.obs.groupBy("source_id", F.floor(F.col("us") / 86_400_000_000).cast("long").alias("day")).agg(F.sum("value").alias("total"))
    return od.detect_regimes(daily, "source_id", "day", "total")
