"""Graph queries over nations, suppliers and customers as an infrastructure graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import routing as ro
from .registry import Tables, haversine_sql, query

#: The SQL's graph: nations 0-19 in a ring with chords, suppliers 1000+ hang on their nation; its statements list all paths.
EDGES_SQL = """WITH RECURSIVE e1 AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 20 AS dst, 1.0 + n_nationkey % 3 AS weight FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, (n_nationkey * 7 + 3) % 20, 2.5 FROM nation WHERE n_nationkey < 20 AND n_nationkey % 5 = 0
 UNION ALL SELECT 1000 + s_suppkey, s_nationkey, 0.5 + s_suppkey % 4 FROM supplier), e AS (SELECT src::BIGINT AS src, dst::BIGINT AS dst, weight::DOUBLE AS weight FROM e1 UNION ALL SELECT dst, src, weight FROM e1)"""
NODES_SQL = ", nodes AS (SELECT n_nationkey::BIGINT AS node FROM nation UNION ALL SELECT 1000 + s_suppkey FROM supplier)"


#: The whole graph has all nations in the ring and hangs customers on theirs, with ids above any supplier's.
CUSTOMER = 10**12


def edges(t: Tables, whole: bool = False) -> DataFrame:
    size = 25 if whole else 20
    n = t.nation.where(F.col("n_nationkey") < size).select(F.col("n_nationkey").cast("long").alias("n"))
    ring = n.select(F.col("n").alias("src"), ((F.col("n") + 1) % size).alias("dst"), (F.col("n") % 3 + 1.0).alias("weight"))
    chords = n.where("n % 5 = 0").select(F.col("n").alias("src"), ((F.col("n") * 7 + 3) % size).alias("dst"), F.lit(2.5).alias("weight"))
    hang = t.supplier.select((F.col("s_suppkey") + 1000).alias("src"), F.col("s_nationkey").cast("long").alias("dst"), (F.col("s_suppkey") % 4 + 0.5).alias("weight"))
    if whole:
        hang = hang.unionByName(t.customer.select((F.col("c_custkey") + CUSTOMER).alias("src"), F.col("c_nationkey").cast("long").alias("dst"), (F.col("c_custkey") % 4 + 0.5).alias("weight")))
    return gr.both_ways(ring.unionByName(chords).unionByName(hang))


def nodes(t: Tables, whole: bool = False) -> DataFrame:
    found = t.nation.select(F.col("n_nationkey").cast("long").alias("node")).unionByName(t.supplier.select((F.col("s_suppkey") + 1000).alias("node")))
    return found.unionByName(t.customer.select((F.col("c_custkey") + CUSTOMER).alias("node"))) if whole else found


def seed(t: Tables, *ids: int) -> DataFrame:
    return nodes(t).where(F.col("node").isin(*ids))


@query(EDGES_SQL + ", w AS (SELECT 1003::BIGINT AS node, 0.0::DOUBLE AS weight, 0 AS hops UNION ALL SELECT e.dst, w.weight + e.weight, w.hops + 1 FROM w JOIN e ON e.src = w.node WHERE w.hops < 3 AND w.weight + e.weight <= 6) SELECT node, min(weight) AS weight, round(greatest(0.05, CASE WHEN arg_min(hops, weight) <= 1 THEN 0.7 WHEN arg_min(hops, weight) = 2 THEN 0.45 ELSE 0.25 END * greatest(0.3, 1 - min(weight) / 8)), 6) AS score FROM w GROUP BY node")
def bfs_propagate(t: Tables, whole: bool = False) -> DataFrame:
    """Nodes within three hops and weight six of a seed, with the propagated severity."""
    out = gr.propagate(edges(t, whole), seed(t, 1003), 3, 6.0)
    return out.select("node", "weight", F.round(gr.hop_score(F.col("weight"), F.col("hops")), 6).alias("score"))


@query(EDGES_SQL + NODES_SQL + ", w AS (SELECT node AS origin, node FROM nodes UNION SELECT w.origin, e.dst FROM w JOIN e ON e.src = w.node) SELECT node, (SELECT min(w.node) FROM w WHERE w.origin = nodes.node) AS component FROM nodes")
def components(t: Tables, whole: bool = False) -> DataFrame:
    return gr.components(nodes(t, whole), edges(t, whole))


@query(EDGES_SQL + ", w AS (SELECT 0::BIGINT AS node UNION SELECT e.dst FROM w JOIN e ON e.src = w.node WHERE e.dst NOT IN (5, 13)) SELECT count(*) AS reachable FROM w")
def reachability(t: Tables, whole: bool = False) -> DataFrame:
    """Size of the part that a node reaches with two nodes blocked."""
    free = edges(t, whole).where(~F.col("dst").isin(5, 13) & ~F.col("src").isin(5, 13))
    return gr.shortest_paths(free, seed(t, 0)).agg(F.count(F.lit(1)).alias("reachable"))


@query(EDGES_SQL + ", w AS (SELECT 2::BIGINT AS node, 0.0::DOUBLE AS weight, [2::BIGINT] AS path UNION ALL SELECT e.dst, w.weight + e.weight, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.node WHERE NOT list_contains(w.path, e.dst)) SELECT node, min(weight) AS weight FROM w GROUP BY node")
def shortest_path(t: Tables, whole: bool = False) -> DataFrame:
    return gr.shortest_paths(edges(t, whole), seed(t, 2))


@query(EDGES_SQL + ", w AS (SELECT 2::BIGINT AS node, 0.0::DOUBLE AS weight UNION SELECT e.dst, w.weight + e.weight FROM w JOIN e ON e.src = w.node WHERE w.weight + e.weight <= 5) SELECT node, min(weight) AS minutes FROM w GROUP BY node")
def isochrone(t: Tables, whole: bool = False) -> DataFrame:
    return gr.shortest_paths(edges(t, whole), seed(t, 2), limit=5.0).select("node", F.col("weight").alias("minutes"))


@query(EDGES_SQL + ", w AS (SELECT 2::BIGINT AS node, 0.0::DOUBLE AS weight, [2::BIGINT] AS path UNION ALL SELECT e.dst, w.weight + e.weight, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.node WHERE NOT list_contains(w.path, e.dst)) SELECT min(weight) AS nominal, min(weight) FILTER (NOT list_contains(path, 4)) AS around, min(weight) FILTER (NOT list_contains(path, 4)) - min(weight) AS extra FROM w WHERE node = 6")
def detour(t: Tables, whole: bool = False) -> DataFrame:
    """Extra weight of the way round a blocked node."""
    return gr.detour(edges(t, whole), seed(t, 2), 6, seed(t, 4))


@query(EDGES_SQL + NODES_SQL + ", w AS (SELECT node AS origin, node FROM nodes WHERE node NOT IN (3, 8) UNION SELECT w.origin, e.dst FROM w JOIN e ON e.src = w.node WHERE e.dst NOT IN (3, 8)), s AS (SELECT origin, count(*) AS n FROM w GROUP BY origin) SELECT round(max(n) / (SELECT count(*) FROM nodes), 6) AS ratio FROM s")
def connectivity_ratio(t: Tables, whole: bool = False) -> DataFrame:
    out = gr.connectivity(nodes(t, whole), edges(t, whole), seed(t, 3, 8))
    return out.select(F.round("ratio", 6).alias("ratio"))


@query("SELECT CASE WHEN node < 25 THEN 'nation' ELSE 'supplier' END AS class, count(*) AS n FROM nodes GROUP BY ALL".join((EDGES_SQL + NODES_SQL + " ", "")))
def graph_stats(t: Tables, whole: bool = False) -> DataFrame:
    return nodes(t, whole).groupBy(F.when(F.col("node") < 25, "nation").when(F.col("node") >= CUSTOMER, "customer").otherwise("supplier").alias("class")).agg(F.count(F.lit(1)).alias("n"))


#: The whole graph in SQL, and least weights by rounds of relaxation: each keeps a node's least weight, so no path is listed.
WHOLE_SQL = f"""WITH RECURSIVE l AS (SELECT n_nationkey::BIGINT AS src, ((n_nationkey + 1) % 25)::BIGINT AS dst, CAST(1.0 + n_nationkey % 3 AS DOUBLE) AS weight FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 7 + 3) % 25, 2.5 FROM nation WHERE n_nationkey % 5 = 0
 UNION ALL SELECT 1000 + s_suppkey, s_nationkey, 0.5 + s_suppkey % 4 FROM supplier UNION ALL SELECT c_custkey + {CUSTOMER}, c_nationkey, 0.5 + c_custkey % 4 FROM customer),
e AS MATERIALIZED (SELECT src, dst, weight FROM l UNION ALL SELECT dst, src, weight FROM l),
nodes AS (SELECT n_nationkey::BIGINT AS node FROM nation UNION ALL SELECT 1000 + s_suppkey FROM supplier UNION ALL SELECT c_custkey + {CUSTOMER} FROM customer)"""


def _relaxed(name: str, start: str, rounds: int = 24, where: str = "") -> str:
    steps = [f"{name}0 AS MATERIALIZED ({start})"]
    for k in range(rounds):
        steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT node, min(w) AS w FROM (SELECT * FROM {name}{k} UNION ALL SELECT e.dst, d.w + e.weight FROM {name}{k} d JOIN e ON e.src = d.node {where}) GROUP BY node)")
    return ", " + ",\n".join([*steps, f"{name} AS (SELECT * FROM {name}{rounds})"])


_HOPS = """SELECT node, min(weight) AS weight, round(greatest(0.05, CASE WHEN arg_min(hops, weight) <= 1 THEN 0.7 WHEN arg_min(hops, weight) = 2 THEN 0.45 ELSE 0.25 END * greatest(0.3, 1 - min(weight) / 8)), 6) AS score FROM w GROUP BY node"""


def _labelled(name: str, start: str, rounds: int = 24, where: str = "") -> str:
    """Least labels by so many rounds along all edges."""
    steps = [f"{name}0 AS MATERIALIZED ({start})"]
    for k in range(rounds):
        steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT node, min(label) AS label FROM (SELECT * FROM {name}{k} UNION ALL SELECT e.dst, d.label FROM {name}{k} d JOIN e ON e.src = d.node {where}) GROUP BY node)")
    return ", " + ",\n".join([*steps, f"{name} AS (SELECT * FROM {name}{rounds})"])


_WHOLE = {
    "bfs_propagate": ", w AS (SELECT 1003::BIGINT AS node, 0.0::DOUBLE AS weight, 0 AS hops UNION ALL SELECT e.dst, w.weight + e.weight, w.hops + 1 FROM w JOIN e ON e.src = w.node WHERE w.hops < 3 AND w.weight + e.weight <= 6) " + _HOPS,
    "components": _labelled("c", "SELECT node, node AS label FROM nodes") + " SELECT node, label AS component FROM c",
    "reachability": _relaxed("d", "SELECT 0::BIGINT AS node, CAST(0 AS DOUBLE) AS w", where="WHERE e.dst NOT IN (5, 13)") + " SELECT count(*) AS reachable FROM d",
    "shortest_path": _relaxed("d", "SELECT 2::BIGINT AS node, CAST(0 AS DOUBLE) AS w") + " SELECT node, w AS weight FROM d",
    "isochrone": _relaxed("d", "SELECT 2::BIGINT AS node, CAST(0 AS DOUBLE) AS w") + " SELECT node, w AS minutes FROM d WHERE w <= 5",
    "detour": _relaxed("d", "SELECT 2::BIGINT AS node, CAST(0 AS DOUBLE) AS w") + _relaxed("r", "SELECT 2::BIGINT AS node, CAST(0 AS DOUBLE) AS w", where="WHERE e.dst <> 4") + " SELECT d.w AS nominal, r.w AS around, r.w - d.w AS extra FROM d LEFT JOIN r USING (node) WHERE d.node = 6",
    "connectivity_ratio": _labelled("c", "SELECT node, node AS label FROM nodes WHERE node NOT IN (3, 8)", where="WHERE e.dst NOT IN (3, 8)") + ", s AS (SELECT label, count(*) AS n FROM c GROUP BY label) SELECT round(max(n) / (SELECT count(*) FROM nodes), 6) AS ratio FROM s",
    "graph_stats": f" SELECT CASE WHEN node < 25 THEN 'nation' WHEN node >= {CUSTOMER} THEN 'customer' ELSE 'supplier' END AS class, count(*) AS n FROM nodes GROUP BY ALL",
}


def _over_whole(plan: Callable) -> None:
    def whole(t: Tables) -> DataFrame:
        return plan(t, whole=True)

    whole.__name__, whole.__doc__ = f"{plan.__name__}_whole", f"``{plan.__name__}`` over the whole graph."
    query(WHOLE_SQL + _WHOLE[plan.__name__])(whole)


for _plan in (bfs_propagate, components, reachability, shortest_path, isochrone, detour, connectivity_ratio, graph_stats):
    _over_whole(_plan)


def _corridor_sql(rounds: int = 16) -> str:
    """Distances of both hubs' trips by so many rounds of relaxation, each the least weight of a node."""
    steps = [
        """WITH n AS (SELECT n_nationkey::BIGINT AS node FROM nation UNION ALL SELECT c_custkey + 1000000000000 FROM customer),
p AS (SELECT node, CAST(-122.0 AS DOUBLE) + sin(node % 100003) * 0.4 AS lon, CAST(47.5 AS DOUBLE) + cos(node % 99991 * 1.7) * 0.3 AS lat FROM n),
l AS (SELECT n_nationkey::BIGINT AS src, ((n_nationkey + 1) % 25)::BIGINT AS dst, CAST(1.0 + n_nationkey % 3 AS DOUBLE) AS weight FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 7 + 3) % 25, 2.5 FROM nation WHERE n_nationkey % 5 = 0
 UNION ALL SELECT c_custkey + 1000000000000, c_nationkey, 0.5 + c_custkey % 4 FROM customer UNION ALL SELECT c_custkey + 1000000000000, (c_nationkey * 3 + 1) % 25, 1.5 + c_custkey % 3 FROM customer WHERE c_custkey % 2 = 0),
e AS MATERIALIZED (SELECT src, dst, weight FROM l UNION ALL SELECT dst, src, weight FROM l), f AS MATERIALIZED (SELECT * FROM e WHERE src NOT IN (3, 8) AND dst NOT IN (3, 8)),
h AS (SELECT DISTINCT e.src AS hub, e.dst AS node, lon, lat FROM e JOIN p ON p.node = e.dst WHERE e.src IN (3, 8) AND e.dst NOT IN (3, 8)),
t AS MATERIALIZED (SELECT a.hub, a.node AS a, b.node AS b FROM h a JOIN h b ON a.hub = b.hub AND a.node < b.node QUALIFY row_number() OVER (PARTITION BY a.hub ORDER BY """ + haversine_sql("a.lon", "a.lat", "b.lon", "b.lat") + """ DESC, a.node DESC, b.node DESC) = 1)"""
    ]
    for name, links in (("u", "e"), ("v", "f")):
        steps.append(f"{name}0 AS MATERIALIZED (SELECT hub, a AS node, CAST(0 AS DOUBLE) AS w FROM t)")
        for k in range(rounds):
            steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT hub, node, min(w) AS w FROM (SELECT * FROM {name}{k} UNION ALL SELECT d.hub, x.dst, d.w + x.weight FROM {name}{k} d JOIN {links} x ON x.src = d.node) GROUP BY ALL)")
    steps.append(f"r AS (SELECT t.*, u.w AS usual, v.w AS around FROM t JOIN u{rounds} u ON u.hub = t.hub AND u.node = t.b LEFT JOIN v{rounds} v ON v.hub = t.hub AND v.node = t.b)")
    return ",\n".join(steps) + """ SELECT hub, a, b, around IS NOT NULL AS available, round(usual, 1) AS nominal, coalesce(round(greatest(0.0, around - usual), 1), 0.0) AS extra,
 round(coalesce(round(greatest(0.0, around - usual), 1), 0.0) * 100 / greatest(round(usual, 1), 1.0), 1) AS percent, round(coalesce(round(greatest(0.0, around - usual), 1), 0.0) / 13.4, 1) AS seconds FROM r"""


@query(_corridor_sql())
def corridor_detours(t: Tables) -> DataFrame:
    """The detour between the open neighbours furthest apart of each blocked nation; customers hang on one nation or on two."""
    found = nodes(t, whole=True).where((F.col("node") < 25) | (F.col("node") >= CUSTOMER))
    placed = found.select("node", (F.sin(F.col("node") % 100003) * 0.4 - 122.0).alias("lon"), (F.cos(F.col("node") % 99991 * 1.7) * 0.3 + 47.5).alias("lat"))
    second = t.customer.where("c_custkey % 2 = 0").select((F.col("c_custkey") + CUSTOMER).alias("src"), ((F.col("c_nationkey") * 3 + 1) % 25).cast("long").alias("dst"), (F.col("c_custkey") % 3 + 1.5).alias("weight"))
    links = edges(t, whole=True).where("(src < 25 OR src >= 1000000000000) AND (dst < 25 OR dst >= 1000000000000)").unionByName(gr.both_ways(second))
    return ro.corridor_detours(placed, links, found.where("node IN (3, 8)")).drop("way")


@query()
def situation_clusters(t: Tables) -> DataFrame:
    """Greedy clusters of each region's events within 1800 m and four hours (order-dependent; no SQL form)."""
    rows = t.obs.select("observation_id", (F.col("source_id") % 25).alias("region"), (F.col("us") / 1e6).alias("at"), "lon", "lat")
    return gr.greedy_clusters(rows, "region", "at", "lon", "lat", "observation_id", 1800.0, 14400.0)
