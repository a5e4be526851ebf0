"""Aggregation operators: weighted medians, evidence vectors, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_median(rows: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Lower weighted median of each key; where half the weight ends exactly at a value, the mean with the next one.

    Equal values are summed up first (partial aggregation), so the window runs over distinct values only."""
    per = rows.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    by = Window.partitionBy(*keys).orderBy(value)
    run = per.withColumns({"__c": F.sum("__w").over(by.rowsBetween(Window.unboundedPreceding, 0)), "__t": F.sum("__w").over(Window.partitionBy(*keys)), "__next": F.lead(value).over(by)})
    first = run.where(F.col("__c") >= F.col("__t") / 2).groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("v"), "__c", "__t", "__next"), value).alias("m"))
    tie = F.abs(F.col("m.__c") - F.col("m.__t") / 2) < 1e-12
    return first.select(*keys, F.when(tie & F.col("m.__next").isNotNull(), (F.col("m.v") + F.col("m.__next")) / 2).otherwise(F.col("m.v")).alias("weighted_median"))


def capped_weights(rows: DataFrame, keys: Sequence[str], value: str, weight: str, least: int = 1) -> DataFrame:
    """(keys, value, weight): whole-number weights summed by value, no single row outweighing the rest of its key together.

    At most one row of a key can hold more than half the weight, so the largest row of each value is all that is kept of
    the rows; a row alone weighs ``least``."""
    per = rows.groupBy(*keys, value).agg(F.sum(weight).alias("__w"), F.max(weight).alias("__top"))
    total = F.sum("__w").over(Window.partitionBy(*keys))
    over = per.withColumn("__rest", total - F.col("__top"))
    capped = F.when(F.col("__top") > F.col("__rest"), F.col("__w") - F.col("__top") + F.greatest(F.lit(least), F.col("__rest"))).otherwise(F.col("__w"))
    return over.select(*keys, value, capped.alias(weight))


def upper_median(values: Column) -> Column:
    """The element at n // 2 of the sorted array; null for an empty one."""
    ordered = F.array_sort(values)
    return F.when(F.size(ordered) > 0, F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int")))


def upper_median_of(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The upper median of each key without gathering a key's values in one cell: ranks over counted distinct values."""
    per = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    by = Window.partitionBy(*keys).orderBy(value)
    run = per.withColumns({"__c": F.sum("__n").over(by.rowsBetween(Window.unboundedPreceding, 0)), "__t": F.sum("__n").over(Window.partitionBy(*keys))})
    return run.where(F.col("__c") > F.floor(F.col("__t") / 2)).groupBy(*keys).agg(F.min(value).alias("median"), F.first("__t").alias("n"))


def freshness(seconds: Column) -> Column:
    """1 at 300 s and below, 0 at 7200 s and above, a line between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(7200.0) - seconds) / 6900.0))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def calibration_error(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    per = rows.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("conf"), F.avg(y).alias("acc"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def confusion(p: Column, y: Column, threshold: float = 0.5) -> dict[str, Column]:
    hit = p >= threshold
    return {
        "tp": F.count_if(hit & (y == 1)), "fp": F.count_if(hit & (y == 0)),
        "fn": F.count_if(~hit & (y == 1)), "tn": F.count_if(~hit & (y == 0)),
    }


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1, false-alarm and missed rates, zero where undefined."""
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {"precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1": part(2 * tp, 2 * tp + fp + fn), "false_alarm": part(fp, fp + tn), "missed": part(fn, tp + fn)}


def forecast_report(rows: DataFrame, model: str, p: str, y: str, lead: str, bins: int = 10) -> DataFrame:
    """(model, n, brier, ece, precision, recall, f1, false_alarm, missed, mae, rmse, lead) of forecasts ``p`` of outcomes ``y``.

    Sums by model and bin are combined before they shuffle, and added up by model: the rows are read once.  Rows without a
    forecast or an outcome do not count; a forecast without a lead time counts for all but the mean lead."""
    said = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    error = F.col(p) - F.col(y)
    per = said.groupBy(model, F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("__bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum(error * error).alias("sq"), F.sum(F.abs(error)).alias("sa"), F.sum(lead).alias("sl"), F.count(lead).alias("nl"),
        *(c.alias(name) for name, c in confusion(F.col(p), F.col(y)).items()),
    )
    whole = per.groupBy(model).agg(F.sum(F.abs(F.col("sy") - F.col("sp"))).alias("gap"), *(F.sum(c).alias(c) for c in ("n", "sq", "sa", "sl", "nl", "tp", "fp", "fn", "tn")))
    n = F.col("n")
    told = rates(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    return whole.select(model, "n", (F.col("sq") / n).alias("brier"), (F.col("gap") / n).alias("ece"), *(c.alias(name) for name, c in told.items()), (F.col("sa") / n).alias("mae"), F.sqrt(F.col("sq") / n).alias("rmse"), F.try_divide("sl", "nl").alias("lead"))
