"""Vector codes and sort-means against plain whole-number loops."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import clusters, codes, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def floats(v):
    return [float(np.float32(x)) for x in v]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def hostile(dims: int, n: int = 330) -> list[tuple]:
    rng = random.Random(dims)
    rows = [(i, floats(rng.gauss(0, 0.2) for _ in range(dims)), rng.choice([0, 1, 2, None])) for i in range(n)]
    rows += [(i, floats(rng.choice([-0.5, 0.0, 0.25]) for _ in range(dims)), 3) for i in range(1000, 1060)]  # ties
    rows += [(2000, floats([0.1] * dims), 1)] * 25 + [(2000, floats([-0.1] * dims), 1)] * 2  # repeated rows and ids
    rows += [(None, floats([0.3] * dims), None), (3, None, 0), (None, None, None), (4, [float("nan")] + [0.0] * (dims - 1), 0)]
    rows += [(5, [None] + [0.0] * (dims - 1), 0), (6, [float("inf")] + [0.0] * (dims - 1), 0), (7, [], 0), (-8, floats([0.5] * (dims - 4)), 0)]
    rows += [(-9, floats([-1e-9] * dims), 2), (-10, floats([30000.0] + [0.0] * (dims - 1)), 2)]
    return rows


def brute_codes(table):
    rows = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in table if good(v)]
    dims = max(Counter(len(v) for _, v, _ in rows if v and len(v) % 4 == 0).items(), key=lambda k: (k[1], k[0]))[0]
    fits = [r for r in rows if len(r[1]) == dims]
    width = dims // 4
    order = sorted(fits, key=lambda r: (r[0] is None, r[0] or 0, b"".join(x.to_bytes(4, "little", signed=True) for x in r[1])))
    books = [[r[1][p * width : (p + 1) * width] for r in order[:256]] for p in range(4)]

    def near(part, book):
        return min((square(part, c), e) for e, c in enumerate(book))

    for _ in range(4):
        for p in range(4):
            held = defaultdict(list)
            for _, v, _ in fits:
                part = v[p * width : (p + 1) * width]
                held[near(part, books[p])[1]].append(part)
            books[p] = [[sum(c) // len(c) for c in zip(*held[e])] if e in held else old for e, old in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, total = [], Counter()
    for i, v, y in rows:
        if len(v) == dims:
            got = [near(v[p * width : (p + 1) * width], books[p]) for p in range(4)]
            out.append((i, y, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got)))
            total[y] += out[-1][3]
        else:
            out.append((i, y, None, None))
    return Counter((*r, total.get(r[1]), sha) for r in out)


def brute_clusters(table, rounds=5):
    rows = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in table if good(v) and len(v) == 64]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), b"".join(x.to_bytes(4, "little", signed=True) for x in r[1]))
    centroids = [r[1] for r in sorted(rows, key=key)[:40]]
    near = lambda v: min((square(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in rows:
            held[near(v)[1]].append(v)
        centroids = [[sum(c) // len(c) for c in zip(*held[k])] if k in held else old for k, old in enumerate(centroids)]
    got = [(i, *near(v)[::-1]) for i, v in rows]
    per = Counter()
    for _, c, d in got:
        per[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, per[c], sum(per.values()), sha[c]) for i, c, d in got)


def test_codes_brute_force(spark):
    table = hostile(16)
    frame = spark.createDataFrame(table, SCHEMA).withColumns({c: F.lit("?") for c in ("v", "code", "error", "size", "n", "of_label", "__e")}).repartition(3)
    assert Counter(map(tuple, codes.compress(frame).collect())) == brute_codes(table)


def test_codes_of_few_and_of_no_vectors(spark):
    few = [(i, floats([i / 7, -i, 0.5, i * i, 1, 2, 3, 4]), None) for i in range(5)]
    assert Counter(map(tuple, codes.compress(spark.createDataFrame(few, SCHEMA)).collect())) == brute_codes(few)
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = codes.compress(spark.createDataFrame([(1, [0.5, 1.0, 2.0], 4)], SCHEMA)).collect()
    assert row.code is None and row.error is None and row.label_error is None


def test_codes_stand_for_their_vectors(spark):
    """A decoded vector lies as far from the original as the code's error says, and the codes stay with rows of any columns."""
    table = hostile(16)
    frame = spark.createDataFrame(table, SCHEMA).repartition(2)
    rows, books = codes.encode(frame)
    back = codes.decode(rows.withColumn("approximation", F.lit(1)), books).collect()
    assert len(back) == rows.count() and {r.approximation is None for r in back if r.code is None} == {True}
    told = Counter((r.vec_id, r.error, tuple(r.approximation)) for r in back if r.code is not None)
    unseen = Counter()
    for i, v, _ in table:
        if good(v) and len(v) == 16:
            whole = [math.floor(1024 * x) for x in v]
            code, error = books.assign(np.array([whole]))
            near = [x / 1024 for p in range(4) for x in books.entries[p][code[0][p]].tolist()]
            assert square(whole, [1024 * x for x in near]) == error[0]
            unseen[i, int(error[0]), tuple(near)] += 1
    assert told == unseen
    assert codes.decode(rows.limit(0), books).count() == 0


def test_new_vectors_find_their_centroids(spark):
    frame = spark.createDataFrame(hostile(64, 120), SCHEMA)
    rows, centroids, inertia = clusters.fit(frame)
    assert sorted(map(str, clusters.nearest_centroids(frame, centroids).collect())) == sorted(map(str, rows.collect()))
    assert sum(inertia.values()) == rows.agg(F.sum("distance")).first()[0]
    none = clusters.fit(frame.limit(0))
    assert none.rows.count() == 0 and none.inertia == {} and clusters.nearest_centroids(frame.limit(0), centroids).count() == 0


def test_components_beyond_the_range_take_no_part(spark):
    table = [(i, floats([i / 50, 0.1, -0.2, 0.3]), 0) for i in range(9)]
    got = codes.compress(spark.createDataFrame([*table, (99, [3e38, 0.0, 0.0, 0.0], 0)], SCHEMA)).collect()
    assert [r.code for r in got if r.vec_id == 99] == [None]
    assert Counter(map(tuple, (r for r in got if r.vec_id != 99))) == brute_codes(table)
    wide = [(i, floats([i / 50] * 64), 0) for i in range(9)]
    found = clusters.cluster(spark.createDataFrame([*wide, (99, [3e38] * 64, 0)], SCHEMA)).collect()
    assert [(r.cluster, r.distance) for r in found if r.vec_id == 99] == [(None, None)] and len(found) == 10


def test_clusters_brute_force(spark):
    table = hostile(64, 150)
    frame = spark.createDataFrame(table, SCHEMA).withColumns({c: F.lit("?") for c in ("v", "cluster", "distance", "sums", "__e")}).repartition(3)
    assert Counter(map(tuple, clusters.cluster(frame).collect())) == brute_clusters([r[:2] for r in table])
    assert clusters.cluster(frame.limit(0)).count() == 0
    few = spark.createDataFrame(table[:7], SCHEMA)
    assert Counter(map(tuple, clusters.cluster(few).collect())) == brute_clusters([r[:2] for r in table[:7]])


def test_clusters_of_doubles(spark):
    rng = random.Random(4)
    table = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(60)]
    got = clusters.cluster(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()
    assert Counter(map(tuple, got)) == brute_clusters(table)


whole = st.integers(-(2**24), 2**24) | st.integers(-3, 3)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9).flatmap(lambda w: st.tuples(st.lists(st.lists(whole, min_size=w, max_size=w), min_size=1, max_size=12), st.lists(st.lists(whole, min_size=w, max_size=w), min_size=1, max_size=20))))
def test_screened_entries(pair):
    x, c = (np.array(a, dtype=np.int64) for a in pair)
    low, high = codes.intervals(x, c)
    for i, a in enumerate(pair[0]):
        for j, b in enumerate(pair[1]):
            exact = sum(q * q for q in b) - 2 * sum(p * q for p, q in zip(a, b))
            assert low[i, j] <= exact <= high[i, j]
    index, distance = codes.nearest(x, c)
    assert [(d, k) for d, k in zip(distance.tolist(), index.tolist())] == [min((square(a, b), j) for j, b in enumerate(pair[1])) for a in pair[0]]


def test_many_candidates_are_settled_in_pieces(monkeypatch):
    monkeypatch.setattr(codes, "PAIRS", 7)
    monkeypatch.setattr(codes, "ROWS", 10)
    rng = np.random.default_rng(1)
    x, c = rng.integers(-1, 2, (50, 3)), rng.integers(-1, 2, (20, 3))
    index, distance = codes.nearest(x, c)
    assert list(zip(distance.tolist(), index.tolist())) == [min((square(a, b), j) for j, b in enumerate(c.tolist())) for a in x.tolist()]


@pytest.mark.parametrize("size", [2, 60, 2**26])
def test_scan_from_any_previous_centroid(size):
    rng = np.random.default_rng(size)
    for _ in range(20):
        x, c = rng.integers(-size, size + 1, (80, 4)), rng.integers(-size, size + 1, (int(rng.integers(1, 15)), 4))
        got, distance = clusters.Centroids(c).assign(x, rng.integers(0, len(c), len(x)))
        assert list(zip(distance.tolist(), got.tolist())) == [min((square(a, b), j) for j, b in enumerate(c.tolist())) for a in x.tolist()]


def test_scan_stops_early():
    """Far centroids are not looked at: clusters apart need a fraction of the distances."""
    rng = np.random.default_rng(2)
    c = rng.integers(-10**5, 10**5, (40, 8))
    x = c[rng.integers(0, 40, 2000)] + rng.integers(-50, 50, (2000, 8))
    asked, plain = [], clusters.squares
    held = clusters.Centroids(c)
    previous, _ = held.assign(x, np.zeros(len(x), dtype=np.int64))
    try:
        clusters.squares = lambda a, b: (asked.append(len(a)), plain(a, b))[1]
        held.assign(x, previous)
    finally:
        clusters.squares = plain
    assert sum(asked) < 2 * len(x)


def test_limit_keeps_distances_in_a_long():
    for dims in (1, 4, 64, 1024, 10**6):
        assert 4 * dims * (2 * vectors.most(dims)) ** 2 < 2**63
