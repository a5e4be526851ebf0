"""The registered queries over a small table, and the pipeline."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import queries
from tidemark.llm.common import keep, table

TABLES = ("documents", "benchmark", "labels", "conversations", "pages", "embeddings")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(tuple(r) for r in want.project(", ".join(cols)).fetchall())


def test_pipeline(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = keep(stage(spark, docs, sf_dir))
        if name != "sharding":
            assert out.columns == columns
        if name in ("quality", "near_dedup", "decontamination"):
            assert 0 < out.count() <= docs.count()
        if name == "near_dedup":
            assert out.count() == out.select("doc_id").distinct().count()
        docs = out
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.shard, r.slot) for r in whole.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in docs.collect())
