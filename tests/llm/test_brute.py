"""Verdicts, bids and scores recomputed from their definitions, one document at a time."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard

from llm_rows import rows
from tidemark.llm import quality, sharding, toxicity


def bid(key, shard: int, seed: str = "shard") -> float:
    """The weight-one bid of a shard: XXH64 of seed, shard and key chained as Spark chains columns."""
    h = 42
    for part in (seed.encode(), shard.to_bytes(4, "little"), None if key is None else key.to_bytes(8, "little", signed=True)):
        if part is not None:
            h = xxhash.xxh64_intdigest(part, h)
    return 1.0 / -math.log(((h >> 11) + 0.5) / 2**53)


def test_every_bid(docs):
    got = sharding.assign_shards(docs).select("doc_id", "shard", "grown_shard").collect()
    for r in got:
        bids = [bid(r.doc_id, s) for s in range(sharding.SHARDS + 1)]
        assert r.shard == max(range(sharding.SHARDS), key=bids.__getitem__)
        assert r.grown_shard == max(range(sharding.SHARDS + 1), key=bids.__getitem__)


def verdict(text: str | None) -> bool:
    data = (text or "").encode()
    if not data:
        return True
    limits = lambda n: next((low, high) for least, low, high in reversed(quality.BANDS) if n >= least)
    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(b))
    low, high = limits(len(data))
    if not low <= ratio(data) <= high:
        return False
    pieces = [data[i : i + quality.CHUNK] for i in range(0, len(data), quality.CHUNK)] if len(data) > quality.CHUNK else []
    pieces = [p for p in pieces if len(p) >= quality.LEAST_CHUNK]
    bad = [p for p in pieces if not limits(len(p))[0] <= ratio(p) <= limits(len(p))[1]]
    return sum(map(len, bad)) <= quality.MOST_BAD_CHUNKS * sum(map(len, pieces))


def test_every_compression_verdict(docs):
    got = quality.score_quality(docs, ["doc_id", "text"]).collect()
    assert len(got) == len(rows()) and all(r.kept == (verdict(r.text) and not r.base_failed) for r in got)
    assert {r.kept for r in got} == {True, False}


@pytest.fixture(scope="module")
def machine():
    fine = [f"the day was {w} and {v} by the river" for w in ("calm", "long", "bright", "green") for v in ("warm", "cold", "wide")] * 5
    bad = [t.replace("and", b) for t, b in zip(fine, ["stupid", "moron", "idiot", "clown"] * 15)]
    return toxicity.train(fine + bad, np.array([0] * len(fine) + [1] * len(bad)))


def features(codes: list[int]) -> dict[int, float]:
    """A word's gap-weighted subsequences of three letters by their slot, gone through one by one, at unit norm."""
    out, norm = Counter(), 0.0
    for a in range(1, toxicity.GAP + 1):
        for b in range(1, toxicity.GAP + 1):
            weight = toxicity.DECAY ** (a + b - 2)
            norm += max(len(codes) - a - b, 0) * weight * weight
            for i in range(len(codes) - a - b):
                out[codes[i] << 12 | codes[i + a] << 6 | codes[i + a + b]] += weight
    return {k: v / math.sqrt(max(norm, 1e-9)) for k, v in out.items()}


def score(machine, text: str | None) -> float:
    codes, starts = toxicity.word_codes(text or "")
    words = [w.tolist() for w in np.split(codes, starts[1:])] if len(starts) else []
    margins = sorted((sum(v * float(machine.table[k]) for k, v in features(w).items()) + machine.bias for w in words), reverse=True)
    top = [max(m, -2.0) for m in margins[: toxicity.TOP]]
    top += [-2.0] * (toxicity.TOP - len(top))
    z = sum(x * w for x, w in zip(top, machine.layer[:-1])) + machine.layer[-1]
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def test_every_toxicity_score(machine):
    texts = [t for _, t, *_ in rows() if t is None or len(t) < 6000] + ["what a mo.ron", "a b c", "id iot IDIOT idi0t", "ß 漢字", "x"]
    for t in texts:
        assert machine.score(t) == pytest.approx(score(machine, t), abs=1e-4), t
