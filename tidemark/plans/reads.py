"""Read queries: one entity with its parts, feeds, queues, listings; deltas of versions; clusters; promotion gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import delta, graph as gr, ledger as op, models as md, ordered as od, spatial as sp
from .ledger import STATES, states
from .registry import Tables, haversine_sql, query

#: The reference's radius of unresolved clusters in metres.
CLUSTER_M = 1500.0

VERSIONS_SQL = """, v AS (SELECT event_key, us // 86400000000 AS version, count(*) AS n, CASE WHEN count(*) >= 8 THEN 'active' WHEN count(*) >= 4 THEN 'quiescent' ELSE 'closed' END AS status,
 max(kind) AS label, count(DISTINCT kind) / 5.0 AS authority, max(value) AS amount, bool_or(kind = 'error' AND k >= 90) AS official FROM obs GROUP BY ALL)"""


def day_versions(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return t.obs.groupBy("event_key", F.floor(F.col("us") / 86_400_000_000).cast("long").alias("version")).agg(
        n.alias("n"), F.when(n >= 8, "active").when(n >= 4, "quiescent").otherwise("closed").alias("status"), F.max("kind").alias("label"), (F.countDistinct("kind") / 5.0).alias("authority"), F.max("value").alias("amount"),
        F.bool_or((F.col("kind") == "error") & (F.col("k") >= 90)).alias("official"),
    )


@query(VERSIONS_SQL + """, l AS (SELECT *, lag(status) OVER w AS ps, lag(label) OVER w AS pl, lag(authority) OVER w AS pa, lag(amount) OVER w AS pm, lag(official) OVER w AS po, row_number() OVER w = 1 AS f FROM v WINDOW w AS (PARTITION BY event_key ORDER BY version)),
d AS (SELECT event_key, version, 'created' AS change, 1.0 AS m FROM l WHERE f UNION ALL SELECT event_key, version, 'status', CASE WHEN status = 'closed' THEN 1.0 ELSE 0.55 END FROM l WHERE NOT f AND status <> ps UNION ALL SELECT event_key, version, 'classification', 0.5 FROM l WHERE NOT f AND label <> pl
UNION ALL SELECT event_key, version, 'confidence', abs(authority - pa) FROM l WHERE NOT f AND abs(authority - pa) >= 0.08 UNION ALL SELECT event_key, version, 'scale', abs(amount - pm) / greatest(abs(pm), 1e-9) FROM l WHERE NOT f AND abs(amount - pm) / greatest(abs(pm), 1e-9) > 0.05
UNION ALL SELECT event_key, version, 'guidance_issued', 1.0 FROM l WHERE NOT f AND official AND NOT po UNION ALL SELECT event_key, version, 'guidance_lapsed', 0.5 FROM l WHERE NOT f AND po AND NOT official)
SELECT event_key, version, change, round(CAST(least(1.0, m) AS DOUBLE), 6) AS magnitude FROM d WHERE round(CAST(least(1.0, m) AS DOUBLE), 6) >= 0.12""", obs=True)
def state_deltas(t: Tables) -> DataFrame:
    """Changes of each event from day to day."""
    return delta.compare(day_versions(t), "event_key", "version").select("event_key", "version", "change", "magnitude")


@query(STATES + ", f AS (SELECT source_id, min(us) AS first_us, max(us) AS last_us, count(*) AS observations FROM obs GROUP BY source_id), s AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY version DESC) = 1) SELECT f.source_id, first_us, last_us, observations, version, n AS state_n, total FROM f LEFT JOIN s USING (source_id)", obs=True)
def event_list(t: Tables) -> DataFrame:
    """Events with their true counts and latest state."""
    f = t.obs.groupBy("source_id").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("observations"))
    s = op.latest(states(t), ["source_id"], ["version"]).select("source_id", "version", F.col("n").alias("state_n"), "total")
    return f.join(s, "source_id", "left").select("source_id", "first_us", "last_us", "observations", "version", "state_n", "total")


@query(" (SELECT 'candidate' AS queue, observation_id AS id, us FROM obs WHERE kind = 'click' AND k < 20 ORDER BY us DESC, observation_id LIMIT 100) UNION ALL (SELECT 'contradiction', observation_id, us FROM obs WHERE kind = 'error' AND k > 90 ORDER BY us DESC, observation_id LIMIT 100)".replace(" (SELECT 'candidate'", " SELECT * FROM (SELECT 'candidate'", 1).replace("UNION ALL (SELECT 'contradiction'", "UNION ALL SELECT * FROM (SELECT 'contradiction'", 1), obs=True)
def review_queue(t: Tables) -> DataFrame:
    """The newest pending candidates and the newest open contradictions, a hundred of each."""
    top = lambda where, name: t.obs.where(where).orderBy(F.desc("us"), "observation_id").limit(100).select(F.lit(name).alias("queue"), F.col("observation_id").alias("id"), "us")
    return top("kind = 'click' AND k < 20", "candidate").unionByName(top("kind = 'error' AND k > 90", "contradiction"))


@query(STATES + " SELECT source_id, version, n, total FROM states QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY version DESC) <= 3", obs=True)
def newest_runs(t: Tables) -> DataFrame:
    """The three newest runs of each event."""
    return sp.best_per(states(t), ["source_id"], [F.desc("version")], 3).select("source_id", "version", "n", "total")


@query(" SELECT observation_id, us FROM obs WHERE source_id = 5 AND kind = 'error' ORDER BY us DESC, observation_id LIMIT 20", obs=True)
def user_notifications(t: Tables) -> DataFrame:
    """A user's newest alerts: filtered before the limit."""
    return t.obs.where("source_id = 5 AND kind = 'error'").orderBy(F.desc("us"), "observation_id").limit(20).select("observation_id", "us")


@query("SELECT n_nationkey, n_name, coalesce(count(s_suppkey), 0) AS suppliers, max(s_acctbal) AS best, CASE WHEN count(s_suppkey) = 0 THEN 'unknown' WHEN max(s_acctbal) < 5000 THEN 'degraded' ELSE 'healthy' END AS state FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def source_listing(t: Tables) -> DataFrame:
    """Declared sources with the health observed for them."""
    per = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("s_suppkey").alias("suppliers"), F.max("s_acctbal").alias("best"))
    rows = t.nation.select("n_nationkey", "n_name").join(per, "n_nationkey", "left").withColumn("suppliers", F.coalesce("suppliers", F.lit(0)))
    return rows.withColumn("state", F.when(F.col("suppliers") == 0, "unknown").when(F.col("best") < 5000, "degraded").otherwise("healthy"))


@query(""", a AS (SELECT source_id, max(value) FILTER (us < 1705363200000000) AS p, max(value) FILTER (us >= 1705363200000000) AS c, count(*) FILTER (us < 1705363200000000) AS pn FROM obs GROUP BY source_id)
SELECT source_id, CASE WHEN p IS NULL THEN 'new' WHEN c IS NULL THEN 'gone' WHEN c - p >= 60 THEN 'worse' WHEN p - c >= 60 THEN 'better' ELSE 'same' END AS change, round(coalesce(c, 0) - coalesce(p, 0), 4) AS moved FROM a""", obs=True)
def user_exposure_change(t: Tables) -> DataFrame:
    """Exposure before and after, by conditional aggregates over one scan instead of a full join of two."""
    cut = F.col("us") < 1_705_363_200_000_000
    a = t.obs.groupBy("source_id").agg(F.max(F.when(cut, F.col("value"))).alias("p"), F.max(F.when(~cut, F.col("value"))).alias("c"))
    p, c = F.col("p"), F.col("c")
    change = F.when(p.isNull(), "new").when(c.isNull(), "gone").when(c - p >= 60, "worse").when(p - c >= 60, "better").otherwise("same")
    return a.select("source_id", change.alias("change"), F.round(F.coalesce(c, F.lit(0.0)) - F.coalesce(p, F.lit(0.0)), 4).alias("moved"))


@query(""", s AS (SELECT event_key, k, us, observation_id, kind, CASE WHEN value >= 200 THEN 3 WHEN value >= 80 THEN 2 ELSE 1 END AS sev FROM obs), l AS (SELECT event_key, k, max(us) FILTER (kind = 'signup') AS resolved_us FROM s GROUP BY ALL)
SELECT s.event_key, s.k, count(*) AS evidence, coalesce(max(CASE WHEN l.resolved_us IS NULL OR s.us > l.resolved_us THEN sev END), 1)::INTEGER AS severity, bool_or(l.resolved_us IS NOT NULL AND l.resolved_us >= s.us) AS touched FROM s JOIN l USING (event_key, k) GROUP BY ALL""", obs=True)
def affected_infrastructure(t: Tables) -> DataFrame:
    """Severity of each affected thing from its reports after the last resolution; a resolved thing stays, at the lowest."""
    s = t.obs.withColumn("sev", F.when(F.col("value") >= 200, 3).when(F.col("value") >= 80, 2).otherwise(1))
    last = F.max(F.when(F.col("kind") == "signup", F.col("us"))).over(Window.partitionBy("event_key", "k"))
    rows = s.withColumn("resolved_us", last)
    counts = rows["resolved_us"].isNull() | (F.col("us") > F.col("resolved_us"))
    return rows.groupBy("event_key", "k").agg(
        F.count(F.lit(1)).alias("evidence"), F.coalesce(F.max(F.when(counts, F.col("sev"))), F.lit(1)).cast("int").alias("severity"), F.bool_or(F.col("resolved_us").isNotNull() & (F.col("resolved_us") >= F.col("us"))).alias("touched")
    )


@query(", g AS (SELECT event_key, count(DISTINCT kind) AS domains, count(DISTINCT source_id) AS agencies, count(*) FILTER (us >= 1705363200000000) AS late, count(*) FILTER (us < 1705363200000000) AS early FROM obs GROUP BY event_key) SELECT event_key, CASE WHEN domains >= 3 AND late > early THEN 'escalating' WHEN late < early * 0.8 THEN 'de_escalating' WHEN agencies >= 3 THEN 'sustained' ELSE 'stable' END AS trajectory, agencies, domains FROM g", obs=True)
def situation_trajectory(t: Tables) -> DataFrame:
    late = F.col("us") >= 1_705_363_200_000_000
    g = t.obs.groupBy("event_key").agg(F.countDistinct("kind").alias("domains"), F.countDistinct("source_id").alias("agencies"), F.count_if(late).alias("late"), F.count_if(~late).alias("early"))
    label = F.when((F.col("domains") >= 3) & (F.col("late") > F.col("early")), "escalating").when(F.col("late") < F.col("early") * 0.8, "de_escalating").when(F.col("agencies") >= 3, "sustained").otherwise("stable")
    return g.select("event_key", label.alias("trajectory"), "agencies", "domains")


@query(f""", p AS (SELECT observation_id, us, lon, lat FROM obs), e AS (SELECT a.observation_id AS x, b.observation_id AS y FROM p a JOIN p b ON a.lat BETWEEN b.lat - 0.02 AND b.lat + 0.02 WHERE a.observation_id < b.observation_id AND {haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 400)
SELECT count(*) AS points, (SELECT count(*) FROM e WHERE x < y) AS links FROM p""", obs=True)
def cluster_links(t: Tables) -> DataFrame:
    """Links of the density graph over which unresolved observations cluster, at the 400 m of its SQL."""
    return _links(t.obs, 400.0)


@query(f""", p AS (SELECT observation_id, lon, lat FROM obs), e AS (SELECT a.observation_id AS x, b.observation_id AS y FROM p a JOIN p b ON a.lat BETWEEN b.lat - 0.02 AND b.lat + 0.02 WHERE a.observation_id < b.observation_id AND {haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 1500)
SELECT count(*) AS points, (SELECT count(*) FROM e WHERE x < y) AS links FROM p""", obs=True)
def density_links(t: Tables) -> DataFrame:
    """The same at the reference's radius, over which ``unresolved_clusters`` are built."""
    return _links(t.obs, CLUSTER_M)


def _links(rows: DataFrame, radius_m: float) -> DataFrame:
    """Counts of rows and of their links, counted by pairs of distinct coordinates, so no pair of rows is made."""
    at = rows.groupBy("lon", "lat").agg(F.min("observation_id").alias("node"), F.count(F.lit(1)).alias("n"))
    placed = at.where("lon IS NOT NULL AND lat IS NOT NULL")
    pairs = sp.within_distance(placed, placed.withColumnsRenamed({"node": "other", "n": "m"}), radius_m).where("node < other")
    between, inside = pairs.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("b")), placed.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("i"))
    return rows.agg(F.count(F.lit(1)).alias("points")).crossJoin(between).crossJoin(inside).select("points", (F.col("b") + F.col("i")).alias("links"))


@query()
def unresolved_clusters(t: Tables) -> DataFrame:
    """Density clusters (components of the graph of near points), cut where a cluster is silent for two hours."""
    return density_clusters(t.obs.select("observation_id", "us", "lon", "lat"))


def density_clusters(p: DataFrame) -> DataFrame:
    """(observation_id, component, session): rows at one coordinate are one node; a row without coordinates stays alone."""
    at = p.where("lon IS NOT NULL AND lat IS NOT NULL").groupBy("lon", "lat").agg(F.min("observation_id").alias("node"))
    pairs = sp.within_distance(at, at.withColumnRenamed("node", "other"), CLUSTER_M)
    edges = pairs.where("node < other").select(F.col("node").alias("src"), F.col("other").alias("dst"))
    named = at.join(gr.components(at.select("node"), edges), "node").select("lon", "lat", "component")
    rows = p.join(named, ["lon", "lat"], "left").withColumn("component", F.coalesce("component", "observation_id"))
    return od.sessions(rows, ["component"], "us", "observation_id", 7_200_000_000).select("observation_id", "component", "session")


@query("WITH m AS (SELECT doc_id, least(1.0, n_chars / 5000.0) AS a, least(1.0, n_chars / 20000.0) AS b, toxic AS y FROM documents JOIN labels USING (doc_id)) SELECT round(avg(power(b - y, 2)), 8) AS candidate_brier, round(avg(power(a - y, 2)), 8) AS champion_brier, count(*) AS samples, avg(power(a - y, 2)) - avg(power(b - y, 2)) >= 0.01 AND count(*) >= 5 AS promote FROM m")
def promotion_gate(t: Tables) -> DataFrame:
    """Whether a challenger's calibrated error beats the champion's by the gate."""
    d = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", F.col("toxic").alias("y")), "doc_id")
    both = F.array(*(F.struct(F.lit(n).alias("model_id"), F.least(F.lit(1.0), F.col("n_chars") / s).alias("p")) for n, s in (("champion", 5000.0), ("candidate", 20000.0))))
    rows = d.select(F.col("doc_id").alias("key"), "y", F.explode(both).alias("m")).select("key", "y", "m.model_id", "m.p")
    out = md.evaluate_promotion(rows, "candidate", "champion")
    return out.select(F.round("candidate_brier", 8).alias("candidate_brier"), F.round("champion_brier", 8).alias("champion_brier"), "samples", "promote")


@query(""", f AS (SELECT event_key, kind AS domain, count(*) FILTER (k >= 50) / count(*) AS share FROM obs GROUP BY ALL) SELECT event_key, domain, horizon, round(CAST(share * s AS DOUBLE), 6) AS p FROM f, (VALUES (5, 0.25), (15, 0.5), (30, 0.75), (60, 1.0)) h(horizon, s)""", obs=True)
def observed_forecasts(t: Tables) -> DataFrame:
    """Share of grounded impacts by domain over four horizons."""
    f = t.obs.groupBy("event_key", F.col("kind").alias("domain")).agg((F.count_if(F.col("k") >= 50) / F.count(F.lit(1))).alias("share"))
    h = F.array(*(F.struct(F.lit(m).alias("horizon"), F.lit(s).alias("s")) for m, s in ((5, 0.25), (15, 0.5), (30, 0.75), (60, 1.0))))
    return f.select("event_key", "domain", "share", F.explode(h).alias("h")).select("event_key", "domain", "h.horizon", F.round(F.col("share") * F.col("h.s"), 6).alias("p"))


@query(""", m AS (SELECT event_key, kind, count(*) AS n FROM obs GROUP BY ALL) SELECT event_key, kind AS label FROM m WHERE kind <> 'view' QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY n DESC, kind DESC) = 1""", obs=True)
def dominant_label(t: Tables) -> DataFrame:
    """The most frequent label of each event, the unknown one aside; of equally frequent ones the last by name."""
    m = t.obs.where("kind <> 'view'").groupBy("event_key", "kind").agg(F.count(F.lit(1)).alias("n"))
    return m.groupBy("event_key").agg(F.max(F.struct("n", "kind"))["kind"].alias("label"))


@query("SELECT consumer, max(us) AS us, count(*) AS n FROM (SELECT kind AS consumer, us FROM obs) GROUP BY consumer".join((" ", "")), obs=True)
def consumer_offsets(t: Tables) -> DataFrame:
    """Where each consumer stands."""
    return t.obs.groupBy(F.col("kind").alias("consumer")).agg(F.max("us").alias("us"), F.count(F.lit(1)).alias("n"))
