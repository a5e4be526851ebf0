"""Ledger queries: point reads, joins to links, versions, as-of, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ledger as op
from .registry import Tables, query

HOUR = 3_600_000_000
#: Hourly state of each source: version, count and total, stamped with the last event of the hour.
STATES = """, states AS (SELECT source_id, us // 3600000000 AS hour, count(*) AS n, round(sum(value), 4) AS total, max(us) AS state_us,
  row_number() OVER (PARTITION BY source_id ORDER BY us // 3600000000) AS version FROM obs GROUP BY source_id, us // 3600000000)"""


def states(t: Tables) -> DataFrame:
    per = t.obs.groupBy("source_id", F.floor(F.col("us") / HOUR).cast("long").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("us").alias("state_us")
    )
    return per.withColumn("version", F.row_number().over(Window.partitionBy("source_id").orderBy("hour")).cast("long"))


@query(", d AS (SELECT *, row_number() OVER (PARTITION BY source_id, k, us // 3600000000 ORDER BY us, observation_id) AS r FROM obs) SELECT source_id, k, observation_id, us FROM d WHERE r = 1", obs=True)
def dedupe_ledger(t: Tables) -> DataFrame:
    rows = t.obs.withColumn("hour", F.floor(F.col("us") / HOUR).cast("long")).select("source_id", "k", "hour", "observation_id", "us")
    return op.dedupe(rows, ["source_id", "k", "hour"], ["us", "observation_id"]).select("source_id", "k", "observation_id", "us")


@query(", d AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY us DESC, observation_id DESC) AS r FROM obs) SELECT source_id, observation_id, kind, value FROM d WHERE r = 1", obs=True)
def latest_per_source(t: Tables) -> DataFrame:
    return op.latest(t.obs.select("source_id", "observation_id", "kind", "value", "us"), ["source_id"], ["us", "observation_id"]).drop("us")


@query(STATES + ", p AS (SELECT observation_id, source_id, us FROM obs) SELECT p.observation_id, p.source_id, p.us, s.state_us, s.version, s.total FROM p ASOF LEFT JOIN states s ON p.source_id = s.source_id AND p.us >= s.state_us", obs=True)
def asof_state(t: Tables) -> DataFrame:
    probes = t.obs.select("observation_id", "source_id", "us")
    return op.as_of(probes, states(t), "source_id", "us", "state_us", ["version", "total"])


@query(STATES + " SELECT source_id, hour, n, total, version FROM states QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY version DESC) = 1", obs=True)
def latest_state(t: Tables) -> DataFrame:
    return op.latest(states(t), ["source_id"], ["version"]).select("source_id", "hour", "n", "total", "version")


@query(STATES + " SELECT source_id, version, hour, total FROM states WHERE source_id = 7", obs=True)
def state_history(t: Tables) -> DataFrame:
    return states(t).where("source_id = 7").select("source_id", "version", "hour", "total").orderBy("version")


@query(""", f AS (SELECT source_id, observation_id, us, kind, lag(kind) OVER w AS before, row_number() OVER w AS r FROM obs WINDOW w AS (PARTITION BY source_id ORDER BY us, observation_id))
SELECT source_id, observation_id, kind, sum(CASE WHEN r > 1 AND before = kind THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY us, observation_id ROWS UNBOUNDED PRECEDING)::BIGINT AS version FROM f""", obs=True)
def fingerprint_versions(t: Tables) -> DataFrame:
    out = op.versions(t.obs.select("source_id", "observation_id", "us", "kind"), ["source_id"], ["us", "observation_id"], "kind")
    return out.select("source_id", "observation_id", "kind", F.col("version").cast("long").alias("version"))


@query("SELECT c_custkey, 1 AS missed_polls, false AS ended FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def missing_records_anti(t: Tables) -> DataFrame:
    active = t.customer.select("c_custkey", F.lit(0).alias("missed_polls"))
    return op.missed_polls(active, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", 2)


@query("SELECT c.c_custkey, c.c_mktsegment, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL ORDER BY n_orders DESC, c_custkey LIMIT 100")
def event_obs_count(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    rows = t.customer.select("c_custkey", "c_mktsegment").join(n, "c_custkey", "left")
    return rows.select("c_custkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n_orders")).orderBy(F.desc("n_orders"), "c_custkey").limit(100)


@query("SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31' AND l_returnflag = 'R'")
def linked_between(t: Tables) -> DataFrame:
    orders = t.orders.where(F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-03-31").cast("timestamp_ntz")))
    lines = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left_semi").select("o_custkey").distinct()


@query("SELECT o_orderkey, o_custkey, o_totalprice, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def recent_linked(t: Tables) -> DataFrame:
    top = t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    names = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return top.join(names, "o_custkey", "left").select("o_orderkey", "o_custkey", "o_totalprice", "c_name")


@query(""", e AS (SELECT source_id, max(us) AS last_us, count(*) AS n FROM obs GROUP BY source_id)
SELECT source_id, CASE WHEN n < 5 THEN 'candidate' WHEN (SELECT max(us) FROM obs) - last_us > 86400000000 THEN 'closed' ELSE 'active' END AS status,
  CASE WHEN n >= 5 AND (SELECT max(us) FROM obs) - last_us > 86400000000 THEN last_us + 86400000000 END AS closed_us FROM e""", obs=True)
def status_case(t: Tables) -> DataFrame:
    per = t.obs.groupBy("source_id").agg(F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"))
    now = t.obs.agg(F.max("us").alias("now"))  # one row
    quiet = (F.col("n") >= 5) & (F.col("now") - F.col("last_us") > 86_400_000_000)
    status = F.when(F.col("n") < 5, "candidate").when(quiet, "closed").otherwise("active")
    return per.crossJoin(F.broadcast(now)).select("source_id", status.alias("status"), F.when(quiet, F.col("last_us") + 86_400_000_000).alias("closed_us"))


@query("""SELECT c_custkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, o.c_mktsegment FROM (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0) o
FULL JOIN (SELECT c_custkey, round(c_acctbal + 1, 2) AS c_acctbal FROM customer WHERE c_custkey % 2 = 0) n USING (c_custkey)""")
def upsert_events(t: Tables) -> DataFrame:
    cols = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    new = cols.where("c_custkey % 2 = 0").select("c_custkey", F.round(F.col("c_acctbal") + 1, 2).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    return op.upsert(cols.where("c_custkey % 3 <> 0"), new, "c_custkey")


@query(""", l AS (SELECT DISTINCT event_key AS event_id, k AS observation_id FROM obs)
SELECT * FROM l WHERE event_id <> 3 UNION ALL SELECT 4, observation_id FROM l WHERE event_id = 3 AND observation_id NOT IN (SELECT observation_id FROM l WHERE event_id = 4)""", obs=True)
def merge_event_links(t: Tables) -> DataFrame:
    links = t.obs.select(F.col("event_key").alias("event_id"), F.col("k").alias("observation_id")).distinct()
    return op.merge_events(links, 3, 4)


@query(", d AS (SELECT source_id, min(observation_id) AS first_id, max(observation_id) AS last_id FROM obs GROUP BY source_id) SELECT source_id AS parent, source_id + 1 AS child, first_id FROM d WHERE source_id = 10 OR source_id + 1 = 10", obs=True)
def relations_for(t: Tables) -> DataFrame:
    per = t.obs.groupBy("source_id").agg(F.min("observation_id").alias("first_id"))
    edges = per.select(F.col("source_id").alias("parent"), (F.col("source_id") + 1).alias("child"), "first_id")
    return edges.where("parent = 10 OR child = 10")


@query(""", a AS (SELECT * FROM obs WHERE observation_id % 2 = 0), b AS (SELECT DISTINCT source_id, k FROM obs WHERE observation_id % 2 = 1)
SELECT (SELECT count(*) FROM (SELECT DISTINCT source_id, k FROM a)) AS known, (SELECT count(*) FROM b WHERE (source_id, k) NOT IN (SELECT (source_id, k) FROM a)) AS accepted,
(SELECT count(*) FROM obs WHERE observation_id % 2 = 1) - (SELECT count(*) FROM b WHERE (source_id, k) NOT IN (SELECT (source_id, k) FROM a)) AS duplicates""", obs=True)
def ingest_counts(t: Tables) -> DataFrame:
    key = F.concat_ws(":", "source_id", "k").alias("dedupe_key")
    half = t.obs.select(key, "observation_id", (F.col("observation_id") % 2).alias("odd"))
    # a key is accepted if its first sight is among the arriving rows: one aggregation instead of an anti-join
    per = half.groupBy("dedupe_key").agg(F.max((F.col("odd") == 0).cast("int")).alias("known"), F.sum("odd").alias("arriving"))
    return per.agg(F.sum("known").alias("known"), F.sum((F.col("known") == 0).cast("long")).alias("accepted"), (F.sum("arriving") - F.sum((F.col("known") == 0).cast("long"))).alias("duplicates"))


@query("SELECT source, count(*) AS n, count(text) AS with_text FROM documents GROUP BY source")
def source_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("with_text"))


@query(""" SELECT source_id, 'obs_' || substr(sha256('["' || source_id || '","' || k || '","' || us || '"]'), 1, 20) AS id, substr(sha256('k=' || k || '&kind=' || kind), 1, 24) AS fingerprint, observation_id FROM obs""", obs=True)
def stamped_ids(t: Tables) -> DataFrame:
    fp = tx.record_fingerprint(F.col("source_id"), {"kind": F.col("kind"), "k": F.col("k"), "views": F.lit(1)})
    return t.obs.select("source_id", tx.deterministic_id("obs", F.col("source_id"), F.col("k"), F.col("us")).alias("id"), fp.alias("fingerprint"), "observation_id")


@query(STATES + """, v AS (SELECT source_id, version, n, total, lag(n) OVER w AS pn, lag(total) OVER w AS pt FROM states WINDOW w AS (PARTITION BY source_id ORDER BY version))
SELECT source_id, version, pn IS NULL AS created, coalesce(n > pn * 2, false) AS escalated, coalesce(n * 2 < pn, false) AS de_escalated, coalesce(abs(total - pt) > 0.05 * abs(pt), false) AS moved FROM v""", obs=True)
def change_flags(t: Tables) -> DataFrame:
    by = Window.partitionBy("source_id").orderBy("version")
    s = states(t).select("source_id", "version", "n", "total", F.lag("n").over(by).alias("pn"), F.lag("total").over(by).alias("pt"))
    no = F.lit(False)
    return s.select(
        "source_id", "version", F.col("pn").isNull().alias("created"), F.coalesce(F.col("n") > F.col("pn") * 2, no).alias("escalated"),
        F.coalesce(F.col("n") * 2 < F.col("pn"), no).alias("de_escalated"), F.coalesce(F.abs(F.col("total") - F.col("pt")) > F.abs("pt") * 0.05, no).alias("moved"),
    )
