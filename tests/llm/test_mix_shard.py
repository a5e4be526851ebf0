"""Mixing and sharding: laws, totals, determinism."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, sharding

from llm_rows import rows


def brute_targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left, open_w = total - sum(stopped.values()), sum(w for s, w in weight.items() if s not in stopped)
        share = {s: left * w / open_w for s, w in weight.items() if s not in stopped} if open_w else {}
        over = [s for s, t in share.items() if t > most * sizes[s] + 1e-9]
        if not over:
            return stopped | share
        stopped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 3, "c": 50, None: 7}, {"b": 10}, {"a": 0, "b": 0}, {"a": 1, "b": 1000, "c": 0, "d": 5, "é": 9}])
def test_targets(spark, sizes):
    sized = spark.createDataFrame([(i, s, n, 0) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long, text_hash long")
    got = {r.source: r.target for r in mixing.targets(sized).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_meets_targets(spark):
    docs = spark.range(9000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 5).cast("int"))).alias("text"),
        F.when(F.col("id") % 3 < 2, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
    )
    first = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")
    one = {r.doc_id: r for r in first.collect()}
    two = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert len(one) == 9000 and two == {d: r.taken for d, r in one.items()}
    took, target = defaultdict(int), {}
    for r in one.values():
        assert r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        took[r.source] += r.taken
        target[r.source] = r.target
    for s, t in target.items():
        assert abs(took[s] - t) <= 2, (s, took[s], t)


def test_mix_documents(docs, empty):
    sized = Counter()
    for r in mixing.mix(docs).collect():
        sized[r.doc_id] += r.copies
    mixed = mixing.apply_mix(docs)
    assert mixed.schema == docs.schema
    assert Counter(r.doc_id for r in mixed.collect()) == +sized
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


def test_shards(docs, empty):
    got = sharding.assign_shards(docs.withColumns({"shard": F.lit("x"), "size": F.lit(0)})).collect()
    assert len(got) == len(rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8 and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(empty).count() == 0


def test_rendezvous_moves_little_and_follows_weights(spark):
    weights = (1.0, 2.0, 1.0)
    keys = spark.range(20_000)
    got = keys.select(sharding.rendezvous(F.col("id"), weights).alias("a"), sharding.rendezvous(F.col("id"), (*weights, 1.0)).alias("b")).collect()
    count = Counter(r.a for r in got)
    assert abs(count[1] / 20_000 - 0.5) < 0.02 and abs(count[0] / 20_000 - 0.25) < 0.02
    moved = [r for r in got if r.a != r.b]
    assert all(r.b == 3 for r in moved) and abs(len(moved) / 20_000 - 0.2) < 0.02
