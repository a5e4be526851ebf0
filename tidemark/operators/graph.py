"""Graph operators over node and edge tables: bounded propagation, reachability, components, routes."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """The frontier written to the shared checkpoint folder and read back, so an iteration's lineage stays short."""
    path = f"{shared(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or _own(spark)).rstrip("/")


def _own(spark: SparkSession) -> str:
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return jsc.getCheckpointDir().get()


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) in both directions."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def propagate(edges: DataFrame, seeds: DataFrame, depth: int, most_weight: float) -> DataFrame:
    """(node, weight, hops): cheapest reach of each node from the seeds, at most ``depth`` hops and ``most_weight``.

    One join and one aggregation a hop: only nodes that got cheaper go on, and a node is kept once."""
    frontier = seeds.select("node", F.lit(0.0).alias("weight"), F.lit(0).alias("hops"))
    reached = frontier
    for hop in range(1, depth + 1):
        steps = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node"), (frontier["weight"] + edges["weight"]).alias("weight"), F.lit(hop).alias("hops")).where(F.col("weight") <= most_weight)
        best = steps.groupBy("node").agg(F.min("weight").alias("weight")).withColumn("hops", F.lit(hop))
        old = reached.groupBy("node").agg(F.min("weight").alias("__old"))
        frontier = kept(best.join(old, "node", "left").where(F.col("__old").isNull() | (F.col("weight") < F.col("__old"))).select("node", "weight", "hops"))
        reached = reached.unionByName(frontier)
    return reached.groupBy("node").agg(F.min("weight").alias("weight"), F.min_by("hops", "weight").alias("hops"))


def shortest_paths(edges: DataFrame, seeds: DataFrame, limit: float | None = None) -> DataFrame:
    """(node, weight): least weight from the seeds by relaxation until nothing gets cheaper, within ``limit`` if given.

    One table a round: the least weight of each node with the round that found it; only that round's nodes go on.
    Weights must not be negative, else it might never end."""
    if not edges.where("weight < 0").isEmpty():
        raise ValueError("shortest_paths needs weights of zero or more")
    state = seeds.select("node", F.lit(0.0).alias("weight"), F.lit(0).alias("round"))
    for r in itertools.count(1):
        frontier = state.where(F.col("round") == r - 1)
        steps = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node"), (frontier["weight"] + edges["weight"]).alias("weight"), F.lit(r).alias("round"))
        if limit is not None:
            steps = steps.where(F.col("weight") <= limit)
        best = F.min(F.struct("weight", "round")).alias("b")  # at equal weight the earlier round stays
        state = kept(state.unionByName(steps).groupBy("node").agg(best).select("node", "b.weight", "b.round"))
        if state.where(F.col("round") == r).isEmpty():
            break
    return state.select("node", "weight")


def routes(edges: DataFrame, seeds: DataFrame, goals: DataFrame) -> DataFrame:
    """(goal, node, back): the nodes of a cheapest way from the seeds to each goal, counted back from the goal.

    Each reached node points to the least of its neighbours on a cheapest way; the goals then follow the pointers, one
    join a hop, all goals at once.  Unreachable goals have no rows.  Weights must be above zero."""
    reached = kept(shortest_paths(edges, seeds))
    near = reached.select(F.col("node").alias("src"), F.col("weight").alias("from"))
    ahead = reached.select(F.col("node").alias("dst"), F.col("weight").alias("to"))
    on_way = edges.join(near, "src").join(ahead, "dst").where((F.col("weight") > 0) & (F.col("from") + F.col("weight") == F.col("to")))
    parent = kept(on_way.groupBy("dst").agg(F.min("src").alias("parent")))
    at = kept(goals.join(reached, "node", "left_semi").select(F.col("node").alias("goal"), "node", F.lit(0).cast("long").alias("back")))
    out = at
    while not (at := kept(at.join(parent, at["node"] == parent["dst"]).select("goal", F.col("parent").alias("node"), (F.col("back") + 1).alias("back")))).isEmpty():
        out = out.unionByName(at)
    return out


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component): the least node of each component, by alternating hooks of larger and smaller neighbours."""
    now = kept(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        two = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = two.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = two.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
        now = kept(large.join(small, "a").select(F.explode(F.array(pair("b", "m"), pair("a", "m"))).alias("e")).select("e.*").where("a <> b").distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return nodes.select("node").join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def detour(edges: DataFrame, start: DataFrame, end: int, blocked: DataFrame) -> DataFrame:
    """(nominal, blocked, extra): least weight from start to end with and without the blocked nodes; null if cut off."""
    free = edges.join(blocked.select(F.col("node").alias("src")), "src", "left_anti").join(blocked.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "weight")
    to = lambda e, name: shortest_paths(e, start).where(F.col("node") == end).agg(F.min("weight").alias(name))
    return to(edges, "nominal").crossJoin(to(free, "around")).withColumn("extra", F.col("around") - F.col("nominal"))


def connectivity(nodes: DataFrame, edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """(ratio): the largest component without the blocked nodes over all nodes."""
    left = nodes.join(blocked, "node", "left_anti")
    free = edges.join(blocked.select(F.col("node").alias("src")), "src", "left_anti").join(blocked.select(F.col("node").alias("dst")), "dst", "left_anti")
    sizes = components(left, free).groupBy("component").count().agg(F.max("count").alias("largest"))
    return sizes.crossJoin(nodes.agg(F.count(F.lit(1)).alias("all"))).select((F.col("largest") / F.col("all")).alias("ratio"))


def hop_score(weight, hops):
    """Propagated severity by hop and weight (fixed values: the shares by hop)."""
    base = F.when(hops <= 1, 0.7).when(hops == 2, 0.45).otherwise(0.25)
    return F.greatest(F.lit(0.05), base * F.greatest(F.lit(0.3), 1 - weight / 8))


def _pieces(events: DataFrame, region: str, time_s: str, lon: str, lat: str, radius_m: float, window_s: float) -> DataFrame:
    """``events`` with the column __piece: rows in different pieces can't reach each other, not even through others.

    Space and time are cut into cells of the radius and the window; rows in reach of each other are in the same or adjacent
    occupied cells, so pieces are the components of these.  Only cells are joined, not rows."""
    step = radius_m / 111320.0 * (1 + 1e-9)
    far = lambda band: F.greatest(F.abs(band), F.abs(band + 1)) * step
    width = lambda band: F.when(far(band) < 89.9, F.lit(step) / F.cos(F.radians(far(band)))).otherwise(1000.0)  # noqa: E731  (one column at a pole)
    band = F.floor(F.col(lat) / step).cast("long")
    celled = events.withColumns({"__b": band, "__c": F.floor(F.col(lon) / width(band)).cast("long"), "__t": F.floor(F.col(time_s) / window_s).cast("long")})
    name = F.concat_ws(":", F.coalesce(F.col(region).cast("string"), F.lit("-")), "__b", "__c", "__t")
    celled = celled.withColumn("__cell", name)
    cells = kept(celled.select(F.col(region).alias("__g"), "__b", "__c", "__t", "__cell").distinct())
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    near = cells.select("*", around.alias("__n")).select("__g", "__c", F.col("__b").alias("__from"), (F.col("__b") + F.col("__n.i")).alias("__b"), (F.col("__t") + F.col("__n.j")).alias("__t"), F.col("__cell").alias("src"))
    own, w = width(F.col("__from")), width(F.col("__b"))
    left = F.col("__c") * own
    near = near.withColumn("__c", F.explode(F.sequence(F.floor((left - own) / w).cast("long"), F.floor((left + 2 * own) / w).cast("long"))))
    keys = [F.col("n.__g").eqNullSafe(F.col("o.__g")), *(F.col(f"n.{k}") == F.col(f"o.{k}") for k in ("__b", "__c", "__t"))]
    links = near.alias("n").join(cells.alias("o"), keys).select("src", F.col("o.__cell").alias("dst")).where("src <> dst")
    pieces = components(cells.select(F.col("__cell").alias("node")), links).select(F.col("node").alias("__cell"), F.col("component").alias("__piece"))
    return celled.join(pieces, "__cell").drop("__cell", "__b", "__c", "__t")


def greedy_clusters(events: DataFrame, region: str, time_s: str, lon: str, lat: str, key: str, radius_m: float, window_s: float) -> DataFrame:
    """(key, seed): time-ordered seed clustering of each region; an event joins the first seed in reach or opens one.

    A region falls into pieces that can't reach each other (``_pieces``).  Each streams through a sorted partition, where only
    the seeds still in the window are held, in cells of the radius; what is dense throughout is one piece, as the order of its
    seeds demands.  A row without a time or a place is a seed of its own."""
    import math
    from collections import OrderedDict, defaultdict, deque

    import pyarrow as pa

    rows = events.select(region, key, time_s, lon, lat)
    whole = F.lit(True)
    for c in (time_s, lon, lat):
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    alone = rows.where(~whole).select(key, F.col(key).alias("seed"))
    rows = _pieces(rows.where(whole), region, time_s, lon, lat, radius_m, window_s).select(region, key, time_s, lon, lat, "__piece")
    rows = rows.repartition("__piece").sortWithinPartitions("__piece", time_s, key)
    kind = events.schema[key].dataType.simpleString()
    step = radius_m / 111320.0 * (1 + 1e-9)

    def column(x: float, band: int) -> int:
        """Columns are as wide as the radius where the band is nearest to a pole."""
        far = max(abs(band), abs(band + 1)) * step
        return math.floor(x * math.cos(math.radians(far)) / step) if far < 89.9 else 0

    def run(batches):
        now, live, cells, opened = None, deque(), defaultdict(OrderedDict), 0
        for batch in batches:
            seeds = []
            for g, k, at, x, y, piece in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (g, piece) != now:
                    now, opened = (g, piece), 0
                    live.clear(), cells.clear()
                while live and at - live[0][0] > window_s:
                    _, cell, n = live.popleft()
                    cells[cell].pop(n)
                    if not cells[cell]:
                        del cells[cell]
                row = math.floor(y / step)
                best = None
                for r in (row - 1, row, row + 1):
                    c = column(x, r)
                    for cell in ((r, c - 1), (r, c), (r, c + 1)):
                        for n, (s, sx, sy) in cells.get(cell, {}).items():
                            if (best is None or n < best[0]) and math.hypot((x - sx) * 111320.0 * math.cos(math.radians(sy)), (y - sy) * 111320.0) <= radius_m:
                                best = n, s
                if best is None:
                    cell, opened, best = (row, column(x, row)), opened + 1, (opened, k)
                    cells[cell][best[0]] = (k, x, y)
                    live.append((at, cell, best[0]))
                seeds.append(best[1])
            of = batch.schema.field(1).type
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(seeds, of)], names=[key, "seed"])

    return rows.mapInArrow(run, f"{key} {kind}, seed {kind}").unionByName(alone)


def top_routes(paths: DataFrame, origin: str, n: int) -> DataFrame:
    return paths.withColumn("rank", F.row_number().over(Window.partitionBy(origin).orderBy("weight", "node"))).where(F.col("rank") <= n)
