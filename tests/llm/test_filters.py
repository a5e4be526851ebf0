"""Quality rules and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, quality

from llm_rows import P, rows

def base_measures(text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    twice = {w for w, k in Counter(windows).items() if k > 1}
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_base_measures(docs):
    got = quality.score_quality(docs, ["doc_id"]).collect()
    want = Counter((d, *base_measures(t)) for d, t, *_ in rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_bands_reject_repetition_and_noise():
    import base64
    import zstandard

    z = zstandard.ZstdCompressor(level=quality.LEVEL)
    random.seed(3)
    words = ["".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 8))) for _ in range(400)]
    prose = " ".join(random.choice(words) for _ in range(3000)).encode()
    assert quality.judge(prose, z)[2]
    assert not quality.judge(b"buy now cheap pills " * 300, z)[2]
    assert not quality.judge(random.randbytes(9000), z)[2]
    # a clean text whose larger part is one repeated chunk fails by its chunks
    assert not quality.judge(prose[:6000] + (b"spam spam eggs " * 3000), z)[2]
    assert quality.judge(b"", z) == (0.0, 0.0, True)


def test_keep_good_returns_documents(docs, empty):
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    verdicts = Counter(r.doc_id for r in quality.score_quality(docs, ["doc_id"]).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == verdicts
    assert quality.keep_good(empty).count() == 0 and quality.score_quality(empty, ["doc_id"]).count() == 0


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        own = words_of(body)
        width = min(13, len(own))
        for at in range(len(own) - width + 1 if width else 0):
            for i in range(len(words) - width + 1):
                if words[i : i + width] == own[at : at + width]:
                    hit |= set(range(i, i + width))
                    found.add("null" if item is None else str(item))
    listed = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), listed, len(hit) > 0 and 20 * len(hit) >= len(words)


ITEMS = [(1, P), (10, "one"), (2, "Two words"), (3, None), (4, ""), (5, "w0x0 w1x1 w2x2"), (None, "wörds — naïve"), (6, P), (7, "t0 t1 t4 t9 t16 t25")]


@pytest.mark.parametrize("block_bytes", [1 << 24, 40])
def test_contamination(spark, docs, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(docs, bench).collect()
    want = Counter((d, *brute(t, ITEMS)) for d, t, *_ in rows())
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want


def test_removal(spark, docs, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.schema == docs.schema
    want = Counter(d for d, t, *_ in rows() if not brute(t, ITEMS)[-1])
    assert Counter(r.doc_id for r in left.collect()) == want
    cut = decontaminate.remove_spans(docs.where("doc_id = 3"), bench).first()
    assert cut.text == " extra"
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs, none).count() == len(rows())
    assert decontaminate.contamination(empty, bench).count() == 0


def test_extra_columns_with_clashing_names(docs):
    odd = docs.withColumns({"hits": F.lit("mine"), "n_words": F.lit("x"), "items": F.lit(1), "kept": F.lit("no")})
    bench = docs.sparkSession.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(odd, bench).count() == len(rows())
    left = decontaminate.drop_contaminated(odd, bench)
    assert left.schema == odd.schema and {r.hits for r in left.collect()} == {"mine"}
    assert quality.score_quality(odd, ["doc_id"]).count() == len(rows())
    assert quality.keep_good(odd).schema == odd.schema
