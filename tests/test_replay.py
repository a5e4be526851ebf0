"""Topic logs and snapshot streams: batches out of order, replays, files that are replaced."""

from __future__ import annotations

import gzip
import os
import random

from tidemark.sources import snapshots as sn
from tidemark.streaming import ledger_stream as ls
from tidemark.streaming import replay as rp

SCHEMA = "topic string, id long, at long, user string"


def test_the_latest_of_each_topic(spark, tmp_path):
    rng, seen = random.Random(1), []
    log = rp.TopicLog(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema, "topic", "at", "id", keep=7)
    assert log.replay().count() == 0
    for number in range(4):
        rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), number * 100 + i, rng.choice([None, *range(30)]), rng.choice(["u", "v", None])) for i in range(40)]
        seen += rows
        log.apply(spark.createDataFrame(rows, SCHEMA), number)
        log.apply(spark.createDataFrame(rows, SCHEMA), number)  # again: nothing is doubled
        want = set()
        for topic in ("a", "b", "hot"):
            want |= set(sorted((r for r in seen if r[0] == topic), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))[-7:])
        got = [tuple(r) for r in log.replay().collect()]
        assert len(got) == len(want) and set(got) == want
    assert {tuple(r) for r in log.replay("hot", "user", "u").collect()} == {r for r in want if r[0] == "hot" and r[3] in ("u", None)}


def drained(spark, tmp_path):
    out = ls.drain(sn.snapshots(spark, str(tmp_path / "in"), ".txt"), "q", str(tmp_path / "c"), str(tmp_path / "out"))
    return sorted((os.path.basename(r.file), r.line, r.value) for r in out.collect())


def test_replaced_files_are_read_again(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("one\r\ntwo\nthree")
    (folder / "b.txt").write_text("b1\n")
    (folder / "empty.txt").write_text("")
    (folder / "c.other").write_text("not asked for")
    (folder / "_hidden.txt").write_text("hidden")
    first = [("a.txt", 0, "one"), ("a.txt", 1, "two"), ("a.txt", 2, "three"), ("b.txt", 0, "b1")]
    assert drained(spark, tmp_path) == first
    assert drained(spark, tmp_path) == first  # nothing changed
    (folder / "b.txt").write_text("b2\nb3\n")
    (folder / "d.txt").write_text("d")
    assert drained(spark, tmp_path) == sorted([*first, ("b.txt", 0, "b2"), ("b.txt", 1, "b3"), ("d.txt", 0, "d")])
    (folder / "a.txt").unlink()
    assert len(drained(spark, tmp_path)) == 7


def test_long_lines_and_compressed_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    long = "x" * (sn.PIECE + 5)
    (tmp_path / "in" / "a.txt.gz").write_bytes(gzip.compress(f"{long}\nétude".encode()))
    out = ls.drain(sn.snapshots(spark, str(tmp_path / "in")), "q", str(tmp_path / "c"), str(tmp_path / "out"))
    assert sorted((len(r.value), r.line) for r in out.collect()) == [(5, 1), (len(long), 0)]
