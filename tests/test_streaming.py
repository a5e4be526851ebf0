"""Streams over folders of files: windows, sessions, versions, resolver state, fan-out, restart."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.streaming import ledger_stream as ls

SCHEMA = "id long, k string, v string, ts timestamp, lon double, lat double"


def drop(spark, folder, name, rows):
    spark.createDataFrame([(i, k, v, t, 0.0, 0.0) for i, k, v, t in rows], "id long, k string, v string, ts string, lon double, lat double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{folder}/{name}")


def source(spark, folder):
    return ls.read_files(spark, f"{folder}/*", SCHEMA)


def run(stream, tmp_path, name="q"):
    return ls.drain(stream, name, str(tmp_path / "checkpoint"), str(tmp_path / "out"))


def test_windows_and_late_rows(spark, tmp_path):
    drop(spark, tmp_path / "in", "a", [(1, "x", "", "2024-01-01 00:01:00"), (2, "x", "", "2024-01-01 00:14:00"), (3, "x", "", "2024-01-01 02:00:00")])
    out = run(ls.tumbling(source(spark, tmp_path / "in"), "ts", "15 minutes", "10 minutes", ["k"]), tmp_path)
    assert [(r.k, r.n) for r in out.collect()] == [("x", 2)]
    drop(spark, tmp_path / "in", "b", [(4, "x", "", "2024-01-01 00:02:00"), (5, "x", "", "2024-01-01 04:00:00")])
    again = run(ls.tumbling(source(spark, tmp_path / "in"), "ts", "15 minutes", "10 minutes", ["k"]), tmp_path)
    assert sorted((r.start.hour, r.n) for r in again.collect()) == [(0, 2), (2, 1)]  # the late row came after its window closed


def test_sessions(spark, tmp_path):
    drop(spark, tmp_path / "in", "a", [(i, "x", "", f"2024-01-01 {t}") for i, t in enumerate(("00:00:00", "00:05:00", "01:00:00", "09:00:00"))])
    out = run(ls.sessions(source(spark, tmp_path / "in"), "ts", "10 minutes", "1 minute", ["k"]), tmp_path)
    assert sorted(r.n for r in out.collect()) == [1, 2]


def test_versions_across_batches(spark, tmp_path):
    drop(spark, tmp_path / "in", "a", [(1, "x", "p", "2024-01-01 00:00:00"), (2, "x", "p", "2024-01-01 00:01:00"), (3, "y", "p", "2024-01-01 00:01:00")])
    run(ls.versions(source(spark, tmp_path / "in"), "k", "v", "ts"), tmp_path)
    drop(spark, tmp_path / "in", "b", [(4, "x", "p", "2024-01-01 00:02:00"), (5, "x", "q", "2024-01-01 00:03:00")])
    out = run(ls.versions(source(spark, tmp_path / "in"), "k", "v", "ts"), tmp_path)
    assert sorted((r.k, r.v, r.version) for r in out.collect()) == [("x", "p", 1), ("x", "q", 2), ("y", "p", 1)]


def test_dedupe(spark, tmp_path):
    drop(spark, tmp_path / "in", "a", [(1, "x", "", "2024-01-01 00:00:00"), (1, "x", "", "2024-01-01 00:01:00"), (2, "x", "", "2024-01-01 00:02:00")])
    out = run(ls.deduped(source(spark, tmp_path / "in"), ["id"], "ts", "1 hour"), tmp_path)
    assert sorted(r.id for r in out.collect()) == [1, 2]


def test_versions_are_forgotten(spark, tmp_path):
    drop(spark, tmp_path / "in", "a", [(1, "x", "p", "2024-01-01 00:00:00"), (2, "y", "p", "2024-01-01 00:00:00"), (3, "x", "p", "2024-01-01 05:00:00")])
    made = lambda: ls.versions(source(spark, tmp_path / "in"), "k", "v", "ts", forget="2 hours")
    assert sorted((r.k, r.version) for r in run(made(), tmp_path).collect()) == [("x", 1), ("x", 1), ("y", 1)]
    drop(spark, tmp_path / "in", "b", [(4, "y", "p", "2024-01-01 06:00:00"), (5, "x", "q", "2024-01-01 05:30:00")])
    assert sorted((r.k, r.v, r.version) for r in run(made(), tmp_path).collect()) == [("x", "p", 1), ("x", "p", 1), ("x", "q", 2), ("y", "p", 1), ("y", "p", 1)]


def test_fan_out(spark, tmp_path):
    drop(spark, tmp_path / "in", "a", [(1, "state", "", "2024-01-01 00:00:00"), (2, "odd", "", "2024-01-01 00:00:00"), (3, None, "", "2024-01-01 00:00:00")])
    ls.fan_out(source(spark, tmp_path / "in"), "k", ["state"], str(tmp_path / "topics"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "topics/state")).count() == 1
    assert spark.read.parquet(str(tmp_path / "topics/dead_letter")).count() == 2
