"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is the expected number of copies of each of its documents.  The whole part is taken
outright; the fraction is an inclusion probability.  The cube method walks the probabilities through the null space
of two balance constraints (number of documents, number of tokens) until they are zero or one: three open documents
always have a direction that keeps both totals, so a flight over a bucket leaves at most two documents open.  The open
documents of all buckets are dealt into fewer buckets and fly again.  Long documents stay open longest, so a source's
last flight keeps some documents back; these and the last two open ones land together near the source's token total.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, keep, key_names, map_slices, with_row_key

#: Weights dealt to the sources in code point order, null last, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source is repeated more often than this.
MOST_COPIES = 3.0
#: Documents of a source that are kept from its last flight for the landing.
LANDING = 60
#: Documents that a bucket keeps open for the next level, beside the two that a flight leaves open.
PASSED_ON = 10
#: Documents of one flight's bucket, on average.
BUCKET_DOCS = 4_000
EPS = 1e-9


def with_size(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_hash): size is the number of ``[^\\x20\\x09-\\x0D]+`` in the text, null has none."""
    narrow = docs.select("doc_id", "source", F.col("text").cast("binary").alias("b"), F.xxhash64("text").alias("text_hash"))

    def count(part: pa.RecordBatch) -> dict[str, list]:
        return {
            "doc_id": part.column("doc_id"),
            "source": part.column("source"),
            "size": [len(b.split()) if b else 0 for b in part.column("b").to_pylist()],
            "text_hash": part.column("text_hash"),
        }

    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return map_slices(narrow, count, f"doc_id {kinds['doc_id']}, source {kinds['source']}, size long, text_hash long")


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, docs, target, copies) per source.

    Sources share all sizes by weight; a share stops at ``most`` times its source's size and the excess is shared
    again.  Ordered by cap over weight the stopped sources are a prefix, so running sums find them without a loop.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(most)
    by = Window.orderBy(cap / F.col("w"), "i")
    earlier, all_rows = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = per.withColumn("i", rank).withColumn("w", weight)
    level = ranked.withColumns(
        {
            "total": F.sum("source_size").over(all_rows),
            "left": F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0)),
            "open_w": F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0)),
        }
    ).withColumn("price", F.col("left") / F.col("open_w"))
    free = cap > F.col("price") * F.col("w")
    final = F.min(F.when(free, F.struct(cap / F.col("w"), F.col("i"), F.col("price").alias("p")))).over(all_rows)["p"]
    target = F.least(cap.cast("double"), F.coalesce(final * F.col("w"), cap.cast("double")))
    return level.withColumn("target", target).select(
        "source", "source_size", "docs", "target",
        F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0).alias("copies"),
    )


def _draw(*parts: object) -> float:
    """A number in (0, 1) that depends on the parts alone."""
    digest = hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=8).digest()
    return (int.from_bytes(digest, "big") + 0.5) / 2.0**64


def _fly(open_: list, decide) -> None:
    """Moves the probabilities of three open units [p, size, row, key] along the null space of (1, size)."""
    (p0, s0), (p1, s1), (p2, s2) = ((u[0], u[1]) for u in open_)
    v = (s1 - s2, s2 - s0, s0 - s1) if not s0 == s1 == s2 else (1.0, -1.0, 0.0)
    p = (p0, p1, p2)
    up = min(((1 - p[k]) if v[k] > 0 else p[k]) / abs(v[k]) for k in range(3) if v[k])
    down = min((p[k] if v[k] > 0 else (1 - p[k])) / abs(v[k]) for k in range(3) if v[k])
    step = up if _draw(*(u[3] for u in open_), p0) * (up + down) < down else -down
    kept = []
    for k in range(3):
        q = p[k] + step * v[k]
        if q <= EPS or q >= 1 - EPS:
            decide(open_[k][2], 1.0 if q > 0.5 else 0.0)
        else:
            open_[k][0] = q
            kept.append(open_[k])
    open_[:] = kept


def _land(open_: list, decide) -> None:
    """The last open units of a source, both totals balanced: as many are taken as their probabilities add up to, one
    fewer or more at most, the likeliest by a random draw first, then swapped while the tokens get nearer."""
    sizes, wanted = [u[1] for u in open_], sum(u[0] * u[1] for u in open_)
    order = sorted(range(len(open_)), key=lambda i: (_draw("land", open_[i][3]) - open_[i][0], i))
    expected = sum(u[0] for u in open_)
    tries = []
    for many in sorted({int(expected + EPS), min(len(open_), int(expected + 1 - EPS))}):
        take = [False] * len(open_)
        for i in order[:many]:
            take[i] = True
        off = sum(s for s, t in zip(sizes, take) if t) - wanted
        while True:
            swaps = [(abs(off - sizes[i] + sizes[j]), i, j) for i, t in enumerate(take) if t for j, u in enumerate(take) if not u]
            best = min(swaps, default=(abs(off), 0, 0))
            if best[0] >= abs(off) - EPS:
                break
            _, i, j = best
            off += sizes[j] - sizes[i]
            take[i], take[j] = False, True
        tries.append((abs(off), many, take))
    for u, t in zip(open_, min(tries)[2]):
        decide(u[2], float(t))
    open_.clear()


def _flights(units: DataFrame) -> DataFrame:
    """One flight over each (source, bucket) of ``units``, which stand together and in order inside a partition.

    Streams with three open units at a time (and LANDING held ones), so a large group needs no memory."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = units.schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, land, open_, held = None, False, [], deque()
        late: list[tuple] = []  # units of earlier batches that are decided or left in this one

        def close(decide) -> None:
            open_.extend(held)
            held.clear()
            if land:
                _land(open_, decide)
            for u in open_:
                decide(u[2], u[0])
            open_.clear()

        def write(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            out: list[tuple] = []
            at_p = arrow.get_field_index("p")

            def decide(row: tuple, p: float, out=out, at_p=at_p) -> None:
                out.append((*row[:at_p], p, *row[at_p + 1 :]))

            where = {f.name: k for k, f in enumerate(arrow)}
            for row in rows:
                if (mine := (row[where["source"]], row[where["bucket"]])) != group:
                    close(decide)
                    group, land = mine, row[where["land"]]
                p = row[where["p"]]
                if p <= EPS or p >= 1 - EPS:
                    decide(row, 1.0 if p > 0.5 else 0.0)
                    continue
                held.append([p, float(row[where["size"]]), row, (row[where["doc_id"]], row[where["text_hash"]])])
                if len(held) > (LANDING if land else PASSED_ON):
                    open_.append(held.popleft())
                while len(open_) > 2:
                    _fly(open_, decide)
            yield from write(out)
        close(lambda row, p: late.append((*row[: arrow.get_field_index("p")], p, *row[arrow.get_field_index("p") + 1 :])))
        yield from write(late)

    return units.mapInArrow(run, schema)


def sample(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sized`` with source_size, target and taken; each row is decided once, equal runs alike.

    Levels of flights: buckets of about ``BUCKET_DOCS`` documents, then the open units of these, until a source has one
    bucket.  The order inside a bucket hashes id, text and size, so it does not depend on how the input is split.
    """
    mix = F.xxhash64(F.lit("cube"), "doc_id", "text_hash", "size")
    units = sized.join(sources.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    units = units.withColumns({"whole": F.floor("copies").cast("long"), "p": F.col("copies") - F.floor("copies"), "bucket": F.lit(0).cast("long"), "land": F.lit(False)})
    most = sources.agg(F.max("docs")).first()[0] or 0
    done: list[DataFrame] = []
    docs, level = F.col("docs"), 0
    while True:
        dealt = F.ceil(docs / BUCKET_DOCS)
        units = units.withColumns({"bucket": F.pmod(F.xxhash64(F.lit(level), mix), F.greatest(dealt, F.lit(1))).cast("long"), "land": dealt <= 1, "__mix": mix})
        dealt_out = units.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "__mix", "doc_id", "size", "text_hash").drop("__mix")
        flown = keep(_flights(dealt_out))
        if most <= BUCKET_DOCS:  # every source has landed
            done.append(flown)
            break
        done.append(flown.where(F.col("p").isin(0.0, 1.0)))
        units = flown.where(~F.col("p").isin(0.0, 1.0))
        docs, most, level = dealt * (PASSED_ON + 2), -(-most // BUCKET_DOCS) * (PASSED_ON + 2), level + 1
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.select("doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies, taken) for every row of ``docs``.

    Null texts have size zero; a source without words has target zero and none of its rows is taken; a null source is
    the last one; repeated rows are decided one by one; an empty table gives no rows.
    """
    sized = keep(with_size(docs))
    return sample(sized, keep(targets(sized, weights)))


def apply_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns of ``docs``."""
    named = ["doc_id", "source"]
    keys = key_names(docs, *named)
    copies, place, n, each = free_names([*docs.columns, *keys], "__copies", "__i", "__n", "__c")
    drawn = with_row_key(mix(docs, weights), F.col("text_hash"), named, keys).groupBy(*keys).agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0)
    keyed = with_row_key(docs, F.xxhash64("text"), named, keys)
    same = Window.partitionBy(*keys)
    # equal rows share their copies; the remainder goes to the first of them
    times = F.floor(F.col(copies) / F.col(n)) + F.when(F.col(place) <= F.col(copies) % F.col(n), 1).otherwise(0)
    return (
        keyed.join(drawn, keys)
        .withColumns({place: F.row_number().over(same.orderBy(keys[0])), n: F.count(F.lit(1)).over(same)})
        .withColumn(each, F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
        .select(*docs.columns)
    )
