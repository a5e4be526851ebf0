"""Model registry, promotion gate, version deltas, nearest neighbours in blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import delta, models as md, similarity as sim


def test_promotion(spark):
    reg = spark.createDataFrame([("a", "impact", "champion", True, 1), ("b", "impact", "shadow", True, 1), ("c", "impact", "shadow", False, 1), ("d", "other", "champion", True, 1)], md.REGISTRY)
    modes = lambda df: {r.model_id: r["mode"] for r in df.collect()}
    wanted = lambda *rows: spark.createDataFrame(rows, "model_id string, mode string")
    assert modes(md.promote(reg, wanted(("b", "champion")))) == {"a": "challenger", "b": "champion", "c": "shadow", "d": "champion"}
    assert modes(md.promote(reg, wanted(("c", "champion"), ("none", "champion")))) == modes(reg)  # untrained, unknown
    assert modes(md.promote(reg, wanted(("b", "challenger"), ("d", "shadow")))) == {"a": "champion", "b": "challenger", "c": "shadow", "d": "shadow"}
    assert {r.model_id: r.place for r in md.listing(reg).collect()} == {"a": 1, "b": 2, "c": 3, "d": 1}
    out = {r.model_id: (r.p, r.status) for r in md.outputs(reg, spark.createDataFrame([("a", 1, 0.5), ("c", 1, 0.9)], "model_id string, key int, p double")).collect()}
    assert out == {"a": (0.5, "ok"), "c": (None, "model_required")}


def test_gate(spark):
    rows = [(m, k, p, k % 2) for k in range(6) for m, p in (("new", 0.9 if k % 2 else 0.1), ("old", 0.5))]
    table = spark.createDataFrame(rows, "model_id string, key int, p double, y int")
    assert md.evaluate_promotion(table, "new", "old").first().promote
    assert not md.evaluate_promotion(table.where("key < 4"), "new", "old").first().promote
    assert not md.evaluate_promotion(table.limit(0), "new", "old").first().promote


def test_deltas(spark):
    s = [("e", 1, "active", "fire", 0.5, 10.0, False), ("e", 2, "active", "fire", 0.5, 10.2, False), ("e", 3, "closed", "fire", 0.7, 30.0, True), ("e", 4, "closed", "fire", 0.7, 30.0, False)]
    table = spark.createDataFrame(s, "k string, v int, status string, label string, authority double, amount double, official boolean")
    got = {(r.v, r.change): r.magnitude for r in delta.compare(table, "k", "v").collect()}
    assert got == {(1, "created"): 1.0, (3, "status"): 1.0, (3, "confidence"): 0.2, (3, "scale"): 1.0, (3, "guidance_issued"): 1.0, (4, "guidance_lapsed"): 0.5}
    assert delta.compare(table.limit(0), "k", "v").count() == 0


def test_nearest_in_blocks(spark, monkeypatch):
    lib = spark.range(30).select(F.col("id").alias("n"), F.array((F.col("id") * 7 % 30).cast("double")).alias("e"))
    targets = lib.select(F.col("n").alias("q"), F.col("e").alias("qe"))
    run = lambda: sorted((r.q, r.n, r.dist) for r in sim.nearest(targets, lib, "q", "n", sim.weighted_l1(F.col("qe"), F.col("e"), [1.0]), 2).collect())
    whole = run()
    monkeypatch.setattr(sim, "BLOCK_ROWS", 7)
    assert run() == whole and len(whole) == 60
