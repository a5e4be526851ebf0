"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits.  Fingerprints that differ in three bits or fewer differ in at
most one bit of some segment, so a fingerprint probes each segment's table with the Hamming ball of radius one and the
full distance decides.  Of two segments that differ in one bit one has the bit set, so it is enough to probe the segment
itself and the segment with one set bit cleared: half a ball finds every pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, keep, key_names, map_slices, raw, with_row_key

SHINGLE = 3
SEED = 42
MOST_BITS = 3
SEGMENT = 32
#: Rounds of component hooking; each joins labels along the links and halves paths, so rounds grow with the logarithm.
MOST_ROUNDS = 60
#: A fingerprint of at least this share of all rows is hot; its component reaches its rows by broadcast (1 / HOT at most).
HOT = 1 / 4096


def fingerprint(text: bytes | None) -> int:
    """Bit by bit the majority of the XXH64 of all 3-word shingles, as an unsigned number; no words give zero."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, seed = xxhash.xxh64_digest, SEED
    joined = b"".join([digest(a + b" " + b + b" " + c, seed) for a, b, c in zip(words, words[1:], words[2:])])
    hashes = np.frombuffer(joined, dtype=np.uint8).reshape(-1, 8)
    n, ones = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) for every row; fp holds the fingerprint's bits as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> dict[str, list]:
        got = [fingerprint(t) for t in part.column("t").to_pylist()]
        return {"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "fp": [f - (1 << 64) if f >> 63 else f for f in got]}

    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), raw().alias("t"))
    return map_slices(narrow, run, f"doc_id {kind}, text_hash long, fp long")


def links(prints: DataFrame) -> DataFrame:
    """(a, b) with a < b: every pair of different fingerprints of the column fp that differ in MOST_BITS bits or fewer.

    ``prints`` holds each fingerprint once.  A pair may be found through both segments and is then given twice.
    """
    low, high = F.col("fp").bitwiseAND((1 << SEGMENT) - 1), F.shiftrightunsigned("fp", SEGMENT)
    cut = prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("part"), low.alias("seg")), F.struct(F.lit(1).alias("part"), high.alias("seg")))).alias("s")).select("fp", "s.*")
    ball = F.expr(f"filter(concat(array(seg), transform(sequence(0, {SEGMENT - 1}), i -> if((shiftright(seg, i) & 1L) = 1L, seg ^ shiftleft(1L, i), null))), k -> k is not null)")
    probes = cut.select(F.col("fp").alias("x"), "part", F.explode(ball).alias("seg"))
    return (
        probes.join(cut, ["part", "seg"])
        .where((F.col("x") != F.col("fp")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("fp"))) <= MOST_BITS))
        .select(F.least("x", "fp").alias("a"), F.greatest("x", "fp").alias("b"))
    )


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, that connect what ``edges`` connect: each task leaves a star for each set that its own edges join.

    A dense ball of m fingerprints has some m * m / 2 links; a task that met them hands on m - 1 at most, and holds no more
    than its fingerprints."""

    def run(batches):
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]  # paths are halved
            return x

        for part in batches:
            for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                a, b = top(a), top(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        stars = [(top(x), x) for x in list(root) if root[x] != x]
        for at in range(0, len(stars), 100_000):
            piece = stars[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in piece], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b) the smallest node reachable.

    Alternates hooking every node's larger neighbours, then its smaller ones, to the least neighbour; the edges turn
    into stars in a number of rounds that grows with the logarithm of the nodes.  Each round is written to the shared
    folder.
    """
    edges = keep(edges.where("a <> b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        hooked = down.join(small, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = keep(hooked.where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(now)
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) for every row of ``docs``.

    component is the least fingerprint (as a signed long) of the component, component_id its smallest doc_id; rows with
    a null doc_id take part and get the smallest id of their component, null if it has none.  Null, empty and blank
    texts share fingerprint zero.  Repeated rows share a fingerprint; an empty table gives no rows.
    """
    marked = keep(with_fingerprint(docs))
    prints = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(forest(links(prints.select("fp"))))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("component"))
    named = keep(placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "n", "component", "component_id"))
    # rows of a hot fingerprint, such as that of all empty texts, stay where they are; the others meet theirs by key
    hot = named.where(F.col("n") >= HOT * marked.count())
    usual = marked.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(named, "fp")
    return usual.unionByName(marked.join(F.broadcast(hot), "fp")).select("doc_id", "text_hash", "fp", "component", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id (nulls last, then by text hash).

    Decided over ids and hashes; the texts move once, for the semi-join.  Of equal rows one stays.
    """
    groups = near_duplicates(docs)
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    keys = key_names(docs, "doc_id")
    (i,) = free_names([*docs.columns, *keys], "__i")
    chosen = with_row_key(groups.groupBy("component").agg(F.min(who).alias("w")).select("w.*"), F.col("text_hash"), ["doc_id"], keys)
    keyed = with_row_key(docs, F.xxhash64("text"), ["doc_id"], keys)
    once = Window.partitionBy(*keys).orderBy(keys[0])
    return keyed.join(chosen.select(*keys), keys, "left_semi").withColumn(i, F.row_number().over(once)).where(F.col(i) == 1).select(*docs.columns)
