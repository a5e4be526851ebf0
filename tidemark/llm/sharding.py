"""Sharding by rendezvous hashing of stable record keys over weighted shards (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names

#: Shards of the registered query, all of weight one.
SHARDS = 8
#: Rows that one numbering group holds on average; groups are (shard, hash bucket).
ROWS_PER_GROUP = 50_000
LEAST_BUCKETS = 32


def rendezvous(key: F.Column, weights: Sequence[float], seed: str = "shard") -> F.Column:
    """The shard of ``key``: the highest of weight / -ln(u), u being a hash of key and shard in (0, 1).

    A new shard only adds one more bid, so rows move into it or stay.  Ties go to the lower shard.
    """
    bids = []
    for s, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(s), key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        bids.append(F.struct((F.lit(float(weight)) / -F.log(u)).alias("bid"), F.lit(-s).alias("s")))
    return (-(F.greatest(*bids) if len(bids) > 1 else bids[0])["s"]).cast("int")


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown_weight: float = 1.0) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to ``docs``.

    * size: UTF-8 bytes of the text plus one; a null text has none (size 1, CRC zero).
    * law is ``key``: the shard depends on doc_id and the weights alone, so copies and repeated ids share a shard,
      and a null doc_id is one more key.
    * slot numbers a shard's rows gaplessly from 0.  Rows are numbered inside (shard, hash bucket) groups of about
      ``ROWS_PER_GROUP`` rows, and a group starts where the rows of the groups before it end; no task sees a whole shard.
      A bucket hashes id and text, so neither one id nor one group of copies fills a group.
    * An empty table gives no rows.  Columns of ``docs`` that bear an output's name are replaced; all others are kept
      as they are, whatever their names.
    """
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.drop(*new).withColumns(
        {
            "size": (F.octet_length(text) + 1).cast("long"),
            "text_crc32": F.crc32(text.cast("binary")),
            "law": F.lit("key"),
            "shard": rendezvous(F.col("doc_id"), weights),
            "grown_shard": rendezvous(F.col("doc_id"), [*weights, grown_weight]),
        }
    )
    n = docs.select("doc_id").count()
    buckets = max(LEAST_BUCKETS, -(-n // (ROWS_PER_GROUP * len(weights))))
    bucket = F.pmod(F.xxhash64(F.lit("slot"), F.col("doc_id"), text), F.lit(buckets))
    b, at, start = free_names([*docs.columns, *new], "__b", "__n", "__start")
    counted = docs.select(rendezvous(F.col("doc_id"), weights).alias("shard"), bucket.alias(b))
    before = Window.partitionBy("shard").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy("shard", b).agg(F.count(F.lit(1)).alias("n")).select("shard", b, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy("shard", b).orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn(b, bucket)
        .withColumn(at, F.row_number().over(inside))
        .join(starts, ["shard", b])
        .withColumn("slot", (F.col(start) + F.col(at) - 1).cast("long"))
        .select(*docs.drop(*new).columns, *new)
    )
