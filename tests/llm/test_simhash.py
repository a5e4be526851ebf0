"""SimHash fingerprints, links and components against brute force."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import xxhash

from tidemark.llm import simhash

from llm_rows import rows


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints: list[tuple]) -> dict:
    """fp -> smallest id reachable over links of three bits or fewer."""
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least: dict = {}
    for d, f in prints:
        r = find(f)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return {f: least.get(find(f)) for f in fps}


def test_near_duplicates(docs):
    got = simhash.near_duplicates(docs).collect()
    prints = [(d, brute_print(t)) for d, t, *_ in rows()]
    parts = brute_components(prints)
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == Counter((d, f, parts[f]) for d, f in prints)


def test_links_find_every_pair(spark):
    random.seed(5)
    fps = set()
    for _ in range(40):
        center = random.getrandbits(64)
        for _ in range(12):
            f = center
            for b in random.sample(range(64), random.randint(0, 4)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps | {0, 1, 7, 15, (1 << 63), (1 << 64) - 1})
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {(r.a, r.b) for r in simhash.links(table).distinct().collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3}
    assert got == want


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain + star + chain[:3], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41) if i} | {1000 + i: 1000 for i in range(1, 30)}


def test_keep_one(docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    ids = Counter(r.doc_id for r in kept.collect())
    parts = brute_components([(d, brute_print(t)) for d, t, *_ in rows()])
    want = Counter({least for least in parts.values() if least is not None})
    want += Counter({None: sum(1 for f, least in parts.items() if least is None)})
    assert ids == want
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_dense_balls_leave_stars(spark):
    """All pairs of a dense ball become a star in the task that finds them; what is connected stays so."""
    rng = random.Random(7)
    ball = [(1 << i) | (1 << j) for i, j in itertools.combinations(range(30), 2)]  # any two differ in four bits or fewer
    others = [rng.getrandbits(63) for _ in range(200)]
    prints = spark.createDataFrame([(f,) for f in {0, *ball, *others, *(o ^ 5 for o in others[:50])}], "fp long")
    found = simhash.links(prints).persist()
    stars = simhash.forest(found.repartition(3))
    assert found.count() > 10_000 and stars.count() < 3 * prints.count()
    want = {r.node: r.root for r in simhash.components(found).collect()}
    assert {r.node: r.root for r in simhash.components(stars).collect()} == want and len(want) > 450
    assert simhash.forest(found.limit(0)).count() == 0
