"""Language identification, toxicity and language-model scoring: held-out accuracy and brute force."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_rows import rows
from tidemark.llm import langid, lm, toxicity

SMALL = "/root/testdata/sf0.01"


def crc(d, n):
    return zlib.crc32(("" if d is None else str(d)).encode()) % n


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    assert len(got) == len(truth)
    held = [d for d in got if got[d].held_out]
    assert set(held) == {d for d in truth if crc(d, 4) == 2}
    assert sum(got[d].lang_pred == truth[d].lang for d in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_never_sees_labels_of_the_scored(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    key = lambda df: sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.identify(df).collect())
    assert key(docs) == key(other)


def test_language_odd_texts(docs, empty):
    got = defaultdict(list)
    for r in langid.identify(docs.withColumn("score", F.lit("x"))).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows())
    assert all(got[d][0].lang_pred == "und" and got[d][0].score == 0 for d in (4, 5, 6))
    assert langid.identify(empty).count() == 0


def test_language_rejects_other_scripts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs)
    assert [p for p, _ in model.predict(["漢字仮名交じり文は日本語の文章である" * 20, "12345 !!! ...", None])] == ["und"] * 3


def test_language_with_all_length_classes():
    """A language whose sample holds a text of every length class: limits keep their type through the table."""
    words = "river stone garden window morning letter bridge winter market silver".split()
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words, n)) for n in (1, 3, 10, 40, 200) for _ in range(4)] + ["ab", "to"]
    rows = [langid.counts(t) for t in texts]
    assert {langid.length_class(int(r.sum())) for r in rows} == set(range(len(langid.LENGTHS) + 1))
    c, least = langid.fit_lang(np.ones(langid.DIMS, dtype=np.float32), "en", rows)
    assert least.dtype == np.float64 and np.frombuffer(least.tobytes(), dtype=np.float64).tolist() == least.tolist()


def test_language_at_the_largest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = langid.identify(docs).groupBy("held_out").count().collect()
    assert sum(r["count"] for r in got) == docs.count()


def brute_language(texts, idf, centroids, langs, limits):
    """Grams counted one by one with the same hash, TF-IDF, cosine and rejection by their definitions."""
    m = (1 << 64) - 1
    k1, k2, k3, m2, m3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
    out = []
    for t in texts:
        low = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in t or ""]
        padded = [0, *(0 if c == " " else ord(c) for c in " ".join("".join(low).split())), 0]
        if len(padded) == 2:
            out.append(("und", 0.0))
            continue
        grams = Counter()
        for i, a in enumerate(padded):
            one = a * k1 & m
            if a:
                grams[one >> 51] += 1
            if i + 1 < len(padded):
                two = (one ^ (padded[i + 1] * k2 & m)) * m2 & m
                grams[two >> 51] += 1
                if i + 2 < len(padded):
                    grams[((two ^ (padded[i + 2] * k3 & m)) * m3 & m) >> 51] += 1
        v = {g: math.log1p(n) * float(idf[g]) for g, n in grams.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosine = [sum(x * float(c[g]) for g, x in v.items()) / norm for c in centroids]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        out.append((langs[best] if cosine[best] >= limits[langid.length_class(sum(grams.values()))] else "und", cosine[best]))
    return out


def test_language_by_definition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    texts = [r.text for r in docs.collect()][:60] + ["", None, "...", "a", "Ünïcödé ß 漢字", "I\u0130x ǅ", "漢字仮名交じり文" * 9]
    got, want = model.predict(texts), brute_language(texts, model.idf, model.centroids, model.langs, model.limits)
    for t, g, w in zip(texts, got, want):
        assert g[1] == pytest.approx(min(1.0, max(0.0, w[1])), abs=2e-5), t
        assert g[0] == w[0] or abs(w[1] - model.limits[langid.length_class(int(langid.counts(t).sum()))]) < 1e-4, t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "!", "a", "ab", "idiot you", "you", "fine day", "good sky", "a b c", "x" * 40, "漢字", "idiot idiot", "... !"]), st.integers(0, 1)), max_size=12), st.sampled_from([None, 0.01, 0.5]))
def test_toxicity_trains_on_any_small_table(rows, prior):
    model = toxicity.train([t for t, _ in rows], np.array([y for _, y in rows]), prior)
    assert all(0 <= model.score(t) <= 1 for t in ("", None, "idiot", "fine", "a", "漢字"))


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    few = docs.join(labels.select("doc_id"), "doc_id")
    got = {r.doc_id: r for r in toxicity.classify(few, labels).collect()}
    held = [(r.toxic, got[r.doc_id].score, got[r.doc_id].predicted) for r in labels.collect() if crc(r.doc_id, 5) == 0]
    assert all(got[r].held_out == (crc(r, 5) == 0) for r in got)
    caught = [p for t, _, p in held if t == 1]
    assert np.mean(caught) > 0.8 and np.mean([p for t, _, p in held if t == 0]) < 0.02


@pytest.fixture(scope="module")
def machine():
    texts = [f"the day was {w} and {v} by the river" for w in ("calm", "long", "bright", "green", "quiet") for v in ("warm", "cold", "wide", "still", "grey")] * 6
    bad = [t.replace("and", b) for t, b in zip(texts, ["stupid", "moron", "idiot", "loser", "clown"] * 30)]
    return toxicity.train(texts + bad, np.array([0] * len(texts) + [1] * len(bad)))


@pytest.mark.parametrize("insult", ["moron", "MORON", "m.o.r.o.n", "m o r o n", "morron", "moxron", "moron###", "Idi0iot", "stu-pid", "stuupid"])
def test_kernel_tolerates_gaps(machine, insult):
    assert machine.score(f"well the river was {insult} today") > machine.score("well the river was lovely today") + 0.2


def test_toxicity_odd_input(spark, docs, empty, machine):
    assert machine.score(None) == machine.score("") == machine.score("... !!!") < 0.5
    labels = spark.createDataFrame([(1, None, 0), (3, 1, 1), (3, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs.withColumn("toxic", F.lit(9)), labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    none = labels.limit(0)
    assert toxicity.classify(docs, none).count() == len(rows()) and toxicity.classify(empty, labels).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.lists(st.integers(0, 2**64 - 1), max_size=50), st.integers(0, 60))
def test_elias_fano(values, others, shift):
    values = np.array(sorted(v >> shift for v in values), dtype=np.uint64)
    code = lm.EliasFano.build(values)
    assert code.get(np.arange(len(values))).tolist() == values.tolist()
    keys = np.concatenate((values, np.array([v >> shift for v in others], dtype=np.uint64)))
    found = code.find(keys)
    there = set(values.tolist())
    for k, at in zip(keys.tolist(), found.tolist()):
        assert (at >= 0) == (k in there) and (at < 0 or values[at] == k)


def test_quantised_probabilities():
    p = np.array([0.0, 1.0, 0.75, 1e-3, 1e-9, 1e-12])
    back = lm.level(lm.quantise(p))
    assert back[0] == 0 and back[1] == 1 and (np.abs(back[1:] / p[1:] - 1) < 5e-6).all()


def test_trie_is_asked_through_its_mapped_file(tmp_path):
    rng = np.random.default_rng(3)
    words = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2))
    pairs = sorted({(int(rng.integers(len(words))), int(rng.integers(0, 1 << lm.BITS)) if rng.random() < 0.5 else int(rng.integers(0, 50))) for _ in range(4000)})
    context, successor = (np.array([p[k] for p in pairs], dtype=np.uint64) for k in (0, 1))
    amount = rng.integers(1, 9, len(pairs))
    counts = np.bincount(context.astype(np.int64), weights=amount, minlength=len(words)).astype(np.int64)
    lm.Trie.build(words, counts, context.astype(np.int64), successor, amount).write(str(tmp_path / "t"))
    trie = lm.Trie.open(str(tmp_path / "t"))
    assert trie.words.find(words).tolist() == list(range(len(words))) and trie.counts.tolist() == counts.tolist()
    start, stop = trie.successors(np.arange(len(words)))
    assert (stop - start).tolist() == np.bincount(context.astype(np.int64), minlength=len(words)).tolist()
    f = lm.level(trie.pair_codes(context.astype(np.int64), successor))
    assert f == pytest.approx((amount - lm.DISCOUNT) / counts[context.astype(np.int64)], rel=1e-5)
    others = [(c, w) for c in range(len(words)) for w in (7, 2**39 + 1) if (c, w) not in set(pairs)]
    assert not trie.pair_codes(*(np.array([o[k] for o in others]) for k in (0, 1))).any()


def brute_lm(table):
    docs = [(d, "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in t or "").encode().split() + [lm.END]) for d, t in table]
    train = [w for d, w in docs if crc(d, 5) != 1]
    c = Counter(x for w in train for x in w)
    pairs = Counter(p for w in train for p in zip([lm.START, *w], w))
    ctx = Counter(x for w in train for x in [lm.START, *w[:-1]])
    follow = Counter(u for u, _ in pairs)
    n, v = sum(c.values()), len(c)
    base = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))

    def p(u, w):
        cu = c[u] if u != lm.START else ctx[u]
        if not cu:
            return base(w)
        return max(pairs[u, w] - lm.DISCOUNT, 0) / cu + lm.DISCOUNT * follow[u] / cu * base(w)

    out = []
    for d, w in docs:
        out.append((d, crc(d, 5) == 1, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(base(x)) for x in w), sum(math.log10(p(a, b)) for a, b in zip([lm.START, *w], w))))
    return out


@pytest.mark.parametrize("block", [lm.BLOCK_TOKENS, 300])
def test_lm_brute_force(docs, empty, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    got = lm.score(docs.select("doc_id", "text", F.lit(1).alias("score"), F.lit(2).alias("block"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(brute_lm([(d, t) for d, t, *_ in rows()]), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])
    assert all(abs(g[6] - w[6]) <= 4e-6 * w[2] + 1e-6 for g, w in zip(got, want))  # a code's rounding for each token
    assert lm.score(empty).count() == 0


def test_lm_common_words_are_dealt_over_shards(docs, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 1e-4)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 500)
    got = sorted((r.n_tokens, r.base_score, r.score) for r in lm.score(docs).collect())
    want = sorted((r[2], r[5], r[6]) for r in brute_lm([(d, t) for d, t, *_ in rows()]))
    assert all(abs(g[2] - w[2]) <= 4e-6 * w[0] + 1e-6 for g, w in zip(got, want))


def test_lm_messages_are_bounded_by_what_a_block_holds():
    """A block writes to the shards that it has words or pairs for, however many shards there are."""
    rng = np.random.default_rng(2)
    hashes = np.unique(rng.integers(1, 2**63, 300).astype(np.uint64))
    stream = rng.integers(0, len(hashes), 2000).astype(np.uint32)
    words = lm.pack(hashes, np.bincount(stream, minlength=len(hashes)).astype(np.uint32))
    data = lm.pack((stream & 0xFFFF).astype(np.uint16), (stream >> 16).astype(np.uint16), np.array([1500, 500], dtype=np.uint32), np.array([0, 1], dtype=np.uint8))
    common = lm.Common(np.sort(np.append(hashes[:3], lm._START_HASH)), np.array([10, 10, 10, 1]))
    sent = {n: [lm.Plan(words, data, n, common).message(s) for s in lm.Plan(words, data, n, common).shards.tolist()] for n in (1, 24, 10**7, 10**12)}
    assert len(sent[1]) == 1 and len(sent[24]) == 24
    assert all(len(m) <= 301 + 2001 for m in sent.values())
    assert sum(map(len, sent[10**12])) < 250 * len(sent[10**12])  # short messages carry no frames
    for n, messages in sent.items():
        got = Counter()
        for m in messages:
            got.update(lm.unpack(m)[0].tolist())
        assert got == Counter([*hashes.tolist(), int(lm._START_HASH)]), n


def test_lm_parts_follow_a_words_tokens(monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 1000)
    assert lm.Common(np.array([5, 9], dtype=np.uint64), np.array([100, 10**6])).parts.tolist() == [lm.PARTS, 4000]


def test_lm_without_a_mounted_folder(docs, monkeypatch):
    assert lm._model_folder("hdfs://there/x") is None
    want = sorted((r.n_tokens, r.base_score, r.score) for r in lm.score(docs).collect())
    monkeypatch.setattr(lm, "_model_folder", lambda root: None)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)  # many shards, and common words in many parts
    monkeypatch.setattr(lm, "COMMON", 1e-4)
    got = sorted((r.n_tokens, r.base_score, r.score) for r in lm.score(docs).collect())
    assert all(g[:2] == w[:2] and abs(g[2] - w[2]) <= 8e-6 * w[0] + 1e-6 for g, w in zip(got, want)) and len(got) == len(want)


def test_lm_beats_its_base_on_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = [r for r in lm.score(docs).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
