"""Ledger operators: append-only tables with deduplication, versions, as-of reads and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order (one partially aggregated shuffle, no window)."""
    first = F.struct(*order).alias("__o")
    packed = rows.select(*keys, first, F.struct(*rows.columns).alias("__row"))
    return packed.groupBy(*keys).agg(F.min_by("__row", "__o").alias("__row")).select("__row.*")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key in the given order."""
    packed = rows.select(*keys, F.struct(*order).alias("__o"), F.struct(*rows.columns).alias("__row"))
    return packed.groupBy(*keys).agg(F.max_by("__row", "__o").alias("__row")).select("__row.*")


def append_new(ledger: DataFrame, arriving: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """The arriving rows that the ledger lacks, each key once."""
    return dedupe(arriving, [key], order).join(ledger.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` over rows of ``old`` by key; null fields of ``new`` keep the old value."""
    rest = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    return joined.select(key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest))


def versions(polls: DataFrame, keys: Sequence[str], order: Sequence[Column | str], fingerprint: str) -> DataFrame:
    """Adds version: it starts at one and rises with every change of fingerprint."""
    by = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(fingerprint).over(by).eqNullSafe(F.col(fingerprint)) & (F.row_number().over(by) > 1), 0).otherwise(1)
    return polls.withColumn("__changed", changed).withColumn("version", F.sum("__changed").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__changed")


def as_of(probes: DataFrame, states: DataFrame, key: str, probe_time: str, state_time: str, payload: Sequence[str], bucket: int = 86_400_000_000) -> DataFrame:
    """Each probe with the payload of the last state of its key at or before its time.

    One union, sorted by key and bucket of time, states first at equal times; a bucket begins with the last state of those
    before it, so a task sorts one bucket of a key."""
    cut = lambda c: F.floor(F.col(c) / bucket).cast("long").alias("__b")
    state = F.struct(state_time, *payload)
    kinds = states.select(state).schema[0].dataType, probes.select(F.struct(*probes.columns)).schema[0].dataType
    left = probes.select(key, cut(probe_time), F.col(probe_time).alias("__t"), F.lit(1).alias("__probe"), F.struct(*probes.columns).alias("__row"), F.lit(None).cast(kinds[0]).alias("__state"))
    right = states.select(key, cut(state_time), F.col(state_time).alias("__t"), F.lit(0).alias("__probe"), F.lit(None).cast(kinds[1]).alias("__row"), state.alias("__state"))
    both = left.unionByName(right)
    per = both.groupBy(key, "__b").agg(F.max_by("__state", F.when(F.col("__state").isNotNull(), F.col("__t"))).alias("__state"))
    earlier = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(key, "__b", F.lit(None).cast("long").alias("__t"), F.lit(-1).alias("__probe"), F.lit(None).cast(kinds[1]).alias("__row"), F.last("__state", ignorenulls=True).over(earlier).alias("__state"))
    by = Window.partitionBy(key, "__b").orderBy(F.expr("__probe < 0").desc(), "__t", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.unionByName(carried.where("__state IS NOT NULL")).withColumn("__last", F.last("__state", ignorenulls=True).over(by)).where("__probe = 1")
    return filled.select("__row.*", *(F.col(f"__last.{c}").alias(c) for c in (state_time, *payload)))


def missed_polls(active: DataFrame, present: DataFrame, key: str, threshold: int) -> DataFrame:
    """Active records that a poll lacks: missed count raised, ended at the threshold."""
    gone = active.join(present.select(key).distinct(), key, "left_anti").withColumn("missed_polls", F.col("missed_polls") + 1)
    return gone.withColumn("ended", F.col("missed_polls") >= threshold)


def merge_events(links: DataFrame, source: int, target: int) -> DataFrame:
    """Links with the source's observations moved to the target, those that the target has already left out."""
    own = links.where(F.col("event_id") == target).select("observation_id")
    moved = links.where(F.col("event_id") == source).join(own, "observation_id", "left_anti").withColumn("event_id", F.lit(target).cast("long"))
    return links.where(F.col("event_id") != source).unionByName(moved.select(*links.columns))
