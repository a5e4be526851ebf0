"""Columns of the input that bear the names of an operator's helpers stay what they are."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from llm_rows import P, rows
from tidemark.llm import chat, decontaminate, mixing, quality, sharding, simhash, toxicity

HELPERS = ("__h", "__k0", "__z0", "__k1", "__z1", "__i", "__n", "__c", "__b", "__start", "__copies", "__found", "__hits", "__items", "found", "text_hash", "copies", "fp", "component")


def test_helper_names_of_the_input_are_kept(spark, docs, monkeypatch):
    odd = docs.withColumns({n: F.lit(f"mine {n}") for n in HELPERS})
    bench = spark.createDataFrame([(1, P), (2, "na na na")], "item_id long, text string")
    mine = lambda df: {tuple(r[n] for n in HELPERS) for r in df.select(*HELPERS).distinct().collect()} == {tuple(f"mine {n}" for n in HELPERS)}
    assert mine(quality.keep_good(odd)) and mine(simhash.keep_one(odd)) and mine(mixing.apply_mix(odd)) and mine(sharding.assign_shards(odd))
    assert mine(decontaminate.drop_contaminated(odd, bench))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    left = decontaminate.drop_contaminated(odd, bench)
    assert mine(left) and left.columns == odd.columns


def test_quality_beside_columns_of_its_own_names(docs):
    odd = docs.withColumns({n: F.lit(f"mine {n}") for n in ("__t", "__T_", "ratio", "Kept")})
    got = quality.score_quality(odd, ["doc_id", "__t", "__T_", "ratio", "Kept"])
    assert got.columns[:3] == ["doc_id", "__t", "__T_"] and [c.lower() for c in got.columns].count("kept") == 1
    assert {(r["__t"], r["__T_"]) for r in got.collect()} == {("mine __t", "mine __T_")}
    plain = quality.score_quality(docs, ["doc_id"])
    assert Counter(map(tuple, got.select(plain.columns).collect())) == Counter(map(tuple, plain.collect()))


def test_capitals_are_words_of_a_removed_span(spark):
    text = "Before it: " + P.upper() + ". After"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, P)], "item_id long, text string")
    assert decontaminate.remove_spans(frame, bench).first().text == "Before it: . After"


def test_repetitive_texts_scan_fast():
    words = [b"same"] * 20_000
    held = decontaminate.WindowSet([(1, b"same " * 20_000), (2, b"same " * 13)])
    assert held.scan(words) == ([(0, 20_000)], {"1", "2"})


def test_clashing_labels_are_toxic_in_any_order(spark, docs):
    pairs = [(i, t) for i in (1, 2, 3, 9, 11, 12, 13, *range(100, 140)) for t in (0, 1)]
    made = lambda p: Counter((r.text, r.toxic) for r in toxicity.training_rows(docs, spark.createDataFrame(p, "doc_id long, toxic int")).collect())
    assert made(pairs) == made(pairs[::-1]) and {t for _, t in made(pairs)} == {1}


def test_kernel_by_enumeration():
    """The kernel of two words is the product of their weighted subsequences, gone through one by one."""
    def features(word):
        codes = toxicity.word_codes(word)[0].tolist()
        out = Counter()
        for i in range(len(codes)):
            for a in range(1, toxicity.GAP + 1):
                for b in range(1, toxicity.GAP + 1):
                    if i + a + b < len(codes):
                        out[codes[i], codes[i + a], codes[i + a + b]] += toxicity.DECAY ** (a + b - 2)
        norm = sum(max(len(codes) - a - b, 0) * toxicity.DECAY ** (2 * (a + b - 2)) for a in range(1, toxicity.GAP + 1) for b in range(1, toxicity.GAP + 1)) ** 0.5
        return {k: v / norm for k, v in out.items()}

    words = ["idiot", "idxiot", "river", "aaaa", "stupid", "étude"]
    made = [features(w) for w in words]
    codes = [toxicity.word_codes(w)[0].tobytes() for w in words]
    got = toxicity.kernel(codes, toxicity.Landmarks(codes))
    for i, a in enumerate(made):
        for j, b in enumerate(made):
            assert abs(got[i, j] - sum(v * b.get(k, 0) for k, v in a.items())) < 1e-5


def test_elements_of_other_shapes_and_deep_records(spark):
    bad = ['{"messages":[{"role":"user"},{"content":"x"}]}', '{"conversations":[{"from":"gpt"}]}', "[" * 50_000, '{"messages":[{"role":"user","content":"ok"},null]}']
    frame = spark.createDataFrame([(i, 0, t) for i, t in enumerate(bad)], "conv_id long, turn int, record string")
    got = chat.format_records(frame, "conv_id", "turn").collect()
    assert len(got) == len(bad) and all(r.layout is None and r.markup is None for r in got)
    assert len(rows()) > 0
