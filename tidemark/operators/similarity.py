"""Nearest neighbours by weighted distance: a stated set of targets against the whole library, in blocks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept

#: Targets that one broadcast holds.
BLOCK_ROWS = 20_000


def weighted_l1(a: Column, b: Column, weights: Sequence[float]) -> Column:
    return reduce(lambda s, iw: s + F.abs(a[iw[0]] - b[iw[0]]) * iw[1], enumerate(weights), F.lit(0.0))


def nearest(targets: DataFrame, library: DataFrame, target_key: str, key: str, distance: Column, n: int, digits: int | None = None, same: Sequence[str] = ()) -> DataFrame:
    """(target_key, library columns, dist): the n nearest library rows of each target other than itself, ties by key; a distance
    that is missing comes last.

    Targets are broadcast in blocks of BLOCK_ROWS, so a growing target set takes more passes, not more memory.  All pairs
    are looked at, but none is sorted unless it can be among the n: a first pass keeps the least distance of each target in
    each of 2 n groups of a task's rows, and the n-th of these bounds what the second lets through.  Tasks are as many as
    the cores allow, so what is shuffled grows with the targets.  ``digits`` rounds distances before they are ranked.
    ``same`` names the columns that distances come from: of rows equal in them only the n + 1 first can be among the n."""
    spark = library.sparkSession
    if same:
        alike = Window.partitionBy(*same).orderBy(key)
        library = library.withColumn("__r", F.row_number().over(alike)).where(F.col("__r") <= n + 1).drop("__r")
    columns = library.columns
    library, targets = kept(library).repartition(2 * spark.sparkContext.defaultParallelism, key), kept(targets)
    total = targets.count()
    blocks = max(1, -(-total // BLOCK_ROWS))
    dealt = targets.withColumn("__b", F.pmod(F.xxhash64(target_key), F.lit(blocks)))
    other, slack = F.col(key) != F.col(target_key), 0.0 if digits is None else 10.0**-digits
    shown = distance if digits is None else F.round(distance, digits)
    parts = []
    for k in range(blocks):
        block = (dealt.where(F.col("__b") == k) if blocks > 1 else dealt).drop("__b")
        group = (F.spark_partition_id() * (2 * n) + F.pmod(F.xxhash64(key), F.lit(2 * n))).alias("__g")
        least = library.join(F.broadcast(block), other).select(target_key, group, distance.alias("__d")).groupBy(target_key, "__g").agg(F.min("__d").alias("__d"))
        bound = least.groupBy(target_key).agg((F.get(F.sort_array(F.collect_list("__d")), F.lit(n - 1)) + slack).alias("__most"))
        bounded = block.join(bound, target_key, "left")
        pairs = library.join(F.broadcast(bounded), other & (F.col("__most").isNull() | (distance <= F.col("__most")))).withColumn("dist", shown)
        ranked = pairs.withColumn("__r", F.row_number().over(Window.partitionBy(target_key).orderBy(F.asc_nulls_last("dist"), key)))
        parts.append(ranked.where(F.col("__r") <= n).select(target_key, *columns, "dist"))
    return reduce(DataFrame.unionByName, parts)
