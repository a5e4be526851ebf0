"""Personal data: base rules against plain regular expressions, the booster on made and planted cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_rows import rows
from tidemark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


TRICKY = [
    "a@b.c_d@e.f x@y @z.w a..b@c-d.e- é@b.co ünder.a@b.cd,q@r.s.t.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 0000300.1.1.1 12.34.56 1.2.3.4444",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111111111111 4111 1111 1111 1112",
    "9 4111111111111111 9-4111111111111111 - 4111111111111111- 5500005555555559x",
    "+1 (415) 555-2671 ++44 20 7946 0958. +123 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 +12345678901) +1 5",
    "😀 +1 (415) 555-2671 😀 me@x.org 漢 10.0.0.1",
    "1" * 3000 + " " + "1-" * 3000 + "a" * 3000 + "@" + "b." * 500,
    "", None, "@", "+", "1.1.1.1", "a@b.c",
]


@pytest.fixture(scope="module")
def booster(spark):
    return pii.fit(spark)


def random_texts(n=400):
    random.seed(9)
    atoms = ["@", ".", "+", "-", " ", "(", ")", "a", "b1", "_", "4111111111111111", "415", "255", "1", "00", "é", "x@y.z", "10.0.0.1", "+1 (415) 555-2671"]
    return ["".join(random.choice(atoms) for _ in range(random.randint(1, 30))) for _ in range(n)]


def test_base_spans(spark):
    texts = TRICKY + random_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = pii.base_spans(F.coalesce("text", F.lit("")))
    got = {r.doc_id: (sorted((s.a, pii.KINDS.index(s.kind), s.b, s.kind) for s in r.s), r.h) for r in frame.select("doc_id", spans.alias("s"), F.sha2(pii.listed(spans), 256).alias("h")).collect()}
    for i, text in enumerate(texts):
        want = brute(text)
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert got[i] == (want, hashlib.sha256(listed.encode()).hexdigest()), text


def test_report_keeps_base_spans(spark, docs, empty):
    got = pii.report(docs.withColumn("base", F.lit(1)))
    out = got.collect()
    assert len(out) == len(rows()) and pii.report(empty).count() == 0
    texts = TRICKY[:6]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(frame).collect():
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for *_, k in want) for n in BASE]
        assert {f"{k}:{a}:{b}" for a, _, b, k in want} <= set(r.spans.split(","))


FOUND = [
    ("email", "write to anna (at) example (dot) com today", "anna (at) example (dot) com"),
    ("phone", "call (918) 555-3922 now", "(918) 555-3922"),
    ("id", "my ssn 123-45-6789 is secret", "123-45-6789"),
    ("secret", 'token = "e7fbfec6a80404dc513b99d3fdbf2a6e53400638" the', "e7fbfec6a80404dc513b99d3fdbf2a6e53400638"),
    ("ip", "from 2001:0db8:85a3:0000:0000:8a2e:0370:7334 to", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
]
CLEAN = ["on 2024-01-02 at 12:30:45 we met", "order 123 456 789 units", "Oneaoutionheertionenandthenmuchmore the", "version 1.2.3 of part 12-345", "look at home.Then and dot the rest", "the_long_name_of_a_field here"]


def test_booster(spark, booster):
    texts = [t for _, t, _ in FOUND] + CLEAN
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {(s.kind, s.m) for s in r.added} for r in pii.find(frame, booster).collect()}
    for i, (kind, _, m) in enumerate(FOUND):
        assert (kind, m) in got[i], (FOUND[i], got[i])
    for i in range(len(FOUND), len(texts)):
        assert not got[i], (texts[i], got[i])


def test_added_spans_do_not_overlap(spark, booster):
    frame = spark.createDataFrame(list(enumerate(random_texts(200))), "doc_id long, text string")
    for r in pii.find(frame, booster).collect():
        every = sorted([(s.a, s.b) for s in r.added])
        assert all(a[1] <= b[0] for a, b in zip(every, every[1:]))
        assert all(s.b <= t.a or t.b <= s.a for s in r.added for t in r.base)


def test_redact(spark, booster):
    frame = spark.createDataFrame([(1, "mail a@b.co or +1 (415) 555-2671."), (2, None), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(frame, booster).collect()}
    assert got == {1: "mail [EMAIL] or [PHONE].", 2: "", 3: "clean"}


def test_only_dataframe_operations(spark, booster, docs):
    plan = pii.find(docs, booster)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


PROPOSED = [
    ("email", "jane [at] example.com", "jane [at] example.com"), ("email", "write to jane(at)example.org now", "jane(at)example.org"),
    ("ip", "host fe80::1 to", "fe80::1"), ("ip", "from 2001:db8:: to", "2001:db8::"),
    ("secret", 'token = "QmxhZGVSdW5uZXJUd2VudHlGb3J0eVh" the', "QmxhZGVSdW5uZXJUd2VudHlGb3J0eVh"), ("secret", 'secret="kQzWvXpLmRtYbNhJcGfDsAqEwUiOxZvKjQyTrBnMlPh" the', "kQzWvXpLmRtYbNhJcGfDsAqEwUiOxZvKjQyTrBnMlPh"),
]


def test_personal_data_proposed_and_kept(spark):
    clean = ["call std::vector or a::b", "We met at noon.Then home", "the_long_name_of_a_field here", "Path/To/Some/File/Here/Too", "Oneaoutionheertionenandthenmuchmore the"]
    texts = spark.createDataFrame(list(enumerate([t for _, t, _ in PROPOSED] + clean)), "doc_id long, text string")
    got = {r.doc_id: {(s.kind, s.m) for s in r.added} for r in pii.find(texts, pii.fit(spark)).collect()}
    assert [(kind, m) in got[i] for i, (kind, _, m) in enumerate(PROPOSED)] == [True] * len(PROPOSED), got
    assert not any(got[len(PROPOSED) + i] for i in range(len(clean))), got


def test_guards_hold_where_patterns_do(spark):
    rng = np.random.default_rng(7)
    atoms = ["jane", "@", " at ", "(at)", " [at] ", ".", " dot ", "(dot)", "com", ":", "::", "1", "fe80", "2024", "-", "_", " ", "4111", "Ab", "DE12", "x" * 20, "/"]
    texts = [(i, "".join(rng.choice(atoms, rng.integers(1, 25)))) for i in range(3000)]
    rows = spark.createDataFrame(texts, "i long, t string")
    bad = rows.select(*(F.count_if(F.col("t").rlike(p) & ~F.col("t").rlike(g)).alias(n) for n, _, p, g in pii.GENERATORS)).first().asDict()
    assert not any(bad.values()), bad


def test_many_spans_take_time_in_proportion(spark, booster):
    """Thirty thousand addresses, cards inside one long run of letters, and spelt addresses: all in seconds."""
    import time

    mails = " ".join(f"u{i}@ex{i % 7}.org" for i in range(30_000))
    cards = "token = '" + "_".join(["4111_1111_1111_1111"] * 10_000) + "'"
    spelt = ", ".join(f"u{i} (at) ex{i % 7} (dot) org" for i in range(10_000))
    frame = spark.createDataFrame([(1, mails), (2, cards), (3, spelt)], "doc_id long, text string").repartition(3)
    started = time.time()
    got = {r.doc_id: r for r in pii.find(frame, booster).select("doc_id", F.size("base").alias("base"), F.size("added").alias("added")).collect()}
    assert time.time() - started < 60
    assert got[1].base == 30_000 and got[1].added == 0 and got[3].added == 10_000
    red = pii.redact(frame.where("doc_id = 3"), booster).first().text
    assert red == ", ".join(["[EMAIL]"] * 10_000)


def test_cut_and_unbeaten_against_brute_force(spark):
    random.seed(4)
    texts = ["", "a", "äß😀" * 700, "".join(chr(random.randint(97, 400)) for _ in range(150_000))]
    spots = [(i, a, min(len(t), a + random.choice((0, 1, 30, 1023, 1024, 1025, 5000)))) for i, t in enumerate(texts) for a in [0, len(t), *(random.randint(0, len(t)) for _ in range(20))]]
    frame = spark.createDataFrame([(texts[i], a, b) for i, a, b in spots], "t string, a int, b int")
    got = frame.select(pii.let(pii.text_pieces(F.col("t")), lambda p: pii.cut(p, F.col("a"), F.col("b"))).alias("c")).collect()
    assert [r.c for r in got] == [texts[i][a:b] for i, a, b in spots]
    for total in (False, True):
        spans = []
        for lane in range(5):
            at = 0
            while at < 6000:
                a = at + random.randint(0, 30)
                at = a + random.choice((1, 2, 9, 400))
                spans.append((a, at, "", "k", lane, float(random.randint(0, 6))))
        rank = (lambda s: (s[5], s[0], s[1], s[4])) if total else (lambda s: s[5])
        want = sorted(s for s in spans if not any(t[0] < s[1] and s[0] < t[1] and rank(t) < rank(s) for t in spans))
        random.shuffle(spans)
        row = spark.createDataFrame([(spans,)], "s array<struct<a:int,b:int,m:string,kind:string,lane:int,rank:double>>")
        assert [tuple(s)[:6] for s in row.select(pii.unbeaten(F.col("s"), 5, total).alias("u")).first().u] == want
