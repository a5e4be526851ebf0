"""Maintained tables against full recomputation, after every batch, replays and failures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import incremental as inc

SCHEMA = "k long, id long, v long"


def rebuild(rows):
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))


def sink(b):
    """Tops seen for the first time, so a row depends on what earlier batches wrote."""
    return b.changed.select("k", "top").join(b.before("tops").select("k", "top"), ["k", "top"], "left_anti")


def made(spark, path, buckets=16, sinks=(("tops", "top long", sink),)):
    return inc.Maintained(spark, str(path), spark.createDataFrame([], SCHEMA).schema, "k", rebuild, ["n", "top"], sinks, buckets)


def batches():
    rng = random.Random(8)
    out = [[(rng.choice([1, 2, 3, None, *range(100, 140)]), b * 1000 + i, rng.randrange(9)) for i in range(60)] for b in range(4)]
    out[2] = []  # an empty batch
    return out


def whole(rows):
    out = {}
    for k, _, v in rows:
        if k is not None:
            n, top = out.get(k, (0, -1))
            out[k] = (n + 1, max(top, v))
    return out


def test_equal_to_a_recomputation_after_every_batch(spark, tmp_path):
    m, seen, tops, versions = made(spark, tmp_path / "a"), [], set(), {}
    assert m.states().count() == 0 and m.committed() == -1
    for number, rows in enumerate(batches()):
        before = whole(seen)
        seen += rows
        m.apply(spark.createDataFrame(rows, SCHEMA), number)
        now = whole(seen)
        for k in now:
            versions[k] = versions.get(k, 0) + (before.get(k) != now[k])
            tops.add((k, now[k][1]))
        assert {r.k: (r.n, r.top) for r in m.states().collect()} == now
        assert {r.k: r.version for r in m.states().collect()} == versions
        got = [(r.k, r.top) for r in m.table("tops").collect()]
        assert sorted(got) == sorted(tops)
        deltas = {(r.k, r.field): (int(r.before), int(r.after)) for r in m.table("deltas").where(F.col("batch") == number).collect()}
        assert deltas == {(k, f): (before[k][i], now[k][i]) for k in now if k in before for i, f in enumerate(("n", "top")) if before[k][i] != now[k][i]}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    m = made(spark, tmp_path / "a")
    a, b = ([(1, 1, 5), (2, 2, 6)], [(1, 3, 7)])
    m.apply(spark.createDataFrame(a, SCHEMA), 0)
    m.apply(spark.createDataFrame(b, SCHEMA), 1)
    look = lambda: {n: sorted(map(str, m.table(n).collect())) for n in ("history", "states", "deltas", "tops")}
    before = look()
    m.apply(spark.createDataFrame(b, SCHEMA), 1)
    m.apply(spark.createDataFrame(a, SCHEMA), 0)
    assert look() == before


def test_a_batch_is_rebuilt_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda k: seen.add(1) or k, "long").asNondeterministic()
    m = inc.Maintained(spark, str(tmp_path / "a"), spark.createDataFrame([], SCHEMA).schema, "k", lambda rows: rebuild(rows.withColumn("k", counted("k"))), ["n", "top"], buckets=4)
    m.apply(spark.createDataFrame([(1, 1, 5), (2, 2, 6)], SCHEMA), 0)
    m.apply(spark.createDataFrame([(1, 3, 7)], SCHEMA), 1)
    assert seen.value == 2 + 2
    assert sorted(tuple(r)[:4] for r in m.table("deltas").collect()) == [(1, 2, "n", "1"), (1, 2, "top", "5")]


def test_a_batch_that_failed_before_its_commit(spark, tmp_path):
    def fails(b):
        if armed:
            raise RuntimeError("lost")
        return sink(b)

    armed = []
    m = made(spark, tmp_path / "a", sinks=(("tops", "top long", fails),))
    m.apply(spark.createDataFrame([(1, 1, 5)], SCHEMA), 0)
    armed.append(1)
    with pytest.raises(RuntimeError):
        m.apply(spark.createDataFrame([(1, 2, 9), (2, 3, 1)], SCHEMA), 1)
    assert {r.k: (r.n, r.top, r.version) for r in m.states().collect()} == {1: (1, 5, 1)}  # what it wrote does not count
    armed.clear()
    m.apply(spark.createDataFrame([(1, 2, 9), (2, 3, 1)], SCHEMA), 1)
    assert {r.k: (r.n, r.top, r.version) for r in m.states().collect()} == {1: (2, 9, 2), 2: (1, 1, 1)}
    assert m.table("history").count() == 3


def test_compacted_tables_go_on(spark, tmp_path):
    m, seen = made(spark, tmp_path / "a"), []
    for number, rows in enumerate(batches()):
        seen += rows
        m.apply(spark.createDataFrame(rows, SCHEMA), number)
        if number != 2:
            m.compact()
            m.compact()  # nothing to do
            m.apply(spark.createDataFrame(rows, SCHEMA), number)  # nor here
        assert {r.k: (r.n, r.top) for r in m.states().collect()} == whole(seen)
        assert sorted((r.k or 0, r.id, r.v) for r in m.table("history").collect()) == sorted((k or 0, i, v) for k, i, v in seen)
    assert not inc.exists(spark, f"{m.root}/history/batch=0") and not inc.exists(spark, f"{m.root}/folded/upto=0")
    assert {r.k: r.version for r in m.states().collect()} == {r.k: r.v for r in m.table("states").groupBy("k").agg(F.max("version").alias("v")).collect()}
    tops = [(r.k, r.top) for r in m.table("tops").collect()]
    assert len(tops) == len(set(tops))


def test_a_fold_without_its_commit_does_not_count(spark, tmp_path, monkeypatch):
    m = made(spark, tmp_path / "a")
    rows = [(1, 1, 5), (2, 2, 6)]
    m.apply(spark.createDataFrame(rows, SCHEMA), 0)
    monkeypatch.setattr(inc, "remove", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        m.compact()  # fails after its commit: the batches' folders are still there
    monkeypatch.undo()
    assert m.table("history").count() == 2 and {r.k: (r.n, r.top) for r in m.states().collect()} == whole(rows)
    m.apply(spark.createDataFrame([(1, 3, 9)], SCHEMA), 1)
    assert {r.k: (r.n, r.top, r.version) for r in m.states().collect()} == {1: (2, 9, 2), 2: (1, 6, 1)}


def test_only_dirty_buckets_are_read(spark, tmp_path):
    m = made(spark, tmp_path / "a", buckets=64)
    m.apply(spark.createDataFrame([(k, k, k) for k in range(500)], SCHEMA), 0)
    dirty = [r.b for r in spark.range(7, 8).select(F.pmod(F.hash("id"), F.lit(64)).alias("b")).collect()]
    read = m.history(dirty, 0)
    assert 0 < read.count() < 30
    filters = read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1]
    assert "bucket" in filters.split("PushedFilters")[0]  # pruned by folder, not row by row


def test_through_a_stream_that_is_started_again(spark, tmp_path):
    m, seen = made(spark, tmp_path / "a"), []
    for number, rows in enumerate(batches()):
        if rows:
            seen += rows
            spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(str(tmp_path / f"in/{number}"))
            m.run(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))).awaitTermination()
    assert {r.k: (r.n, r.top) for r in m.states().collect()} == whole(seen)
