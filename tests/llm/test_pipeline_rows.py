"""The five stages over hostile rows, with columns of their own and with none at all."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_rows import P, rows, SCHEMA


@pytest.fixture
def folder(spark, tmp_path):
    def make(docs, items):
        docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    return make


def test_hostile_rows_through_all_stages(spark, folder):
    docs = spark.createDataFrame(rows(), SCHEMA).withColumns({"__found": F.lit("mine"), "shard_note": F.col("doc_id") * 2})
    sf_dir = folder(docs, [(1, "t0 t7 t14"), (2, None), (3, "")])
    out = corpus_pipeline.run(spark, sf_dir)
    got = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns
    given = Counter(r[:5] for r in rows())
    assert {tuple(r[:5]) for r in got} <= set(given) and {r["__found"] for r in got} == {"mine"}
    assert all(r.shard_note == (None if r.doc_id is None else r.doc_id * 2) for r in got)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    texts = [r.text for r in got]
    assert None not in texts and not {"", " \t\n ", "one", "one two"} & set(texts)
    assert P + " extra" in texts or P in texts


def test_empty_table_through_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder(spark.createDataFrame([], SCHEMA), [(1, P)]))
    assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
