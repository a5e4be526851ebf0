"""Ordered operators: gaps, silence, lifecycles, rates, point-in-time features, change points."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values of the silence policy: seconds and multiples
SILENCE_FLOOR, SILENCE_CEILING, SILENCE_GAPS, CLOSE_MULTIPLE = 900.0, 21600.0, 8.0, 2.0


#: Microseconds of a bucket of time, in which a key's rows are sorted by one task.
BUCKET_US = 86_400_000_000


def _marked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], carried: Column, per: DataFrame, kind: str, bucket: int) -> DataFrame:
    """``rows`` with __b and, first in each bucket of each key that has one, a row with __m true and __carry: what ``carried``
    says of the key's buckets before.  Only one narrow row a bucket is ordered by key."""
    marks = per.select(*keys, "__b", carried.alias("__carry"), F.lit(True).alias("__m")).where("__carry IS NOT NULL")
    own = rows.withColumns({"__b": _bucket(order[0], bucket), "__carry": F.lit(None).cast(kind), "__m": F.lit(False)})
    return own.unionByName(marks, allowMissingColumns=True)


def _bucket(time: str, bucket: int) -> Column:
    return F.floor(F.col(time) / bucket).cast("long")


def lagged(rows: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str] = (), bucket: int = BUCKET_US) -> DataFrame:
    """``rows`` with __before: ``order`` and ``payload`` of the key's row before, null for its first.

    The same as a lag over the key, but a task sorts one bucket of one key, and a bucket's first row gets the last one of the
    bucket before from a marker; ``order`` starts with the time that is cut into buckets."""
    names = list(dict.fromkeys([*order, *payload]))
    held = F.struct(*names)
    kind = rows.select(held.alias("h")).schema[0].dataType.simpleString()
    per = rows.groupBy(*keys, _bucket(order[0], bucket).alias("__b")).agg(F.max_by(held, F.struct(*order)).alias("__last"))
    both = _marked(rows, keys, order, F.lag("__last").over(Window.partitionBy(*keys).orderBy("__b")), per, kind, bucket)
    by = Window.partitionBy(*keys, "__b").orderBy(F.desc("__m"), *order)
    own = F.when(F.col("__m"), F.col("__carry")).otherwise(held)
    return both.withColumn("__own", own).withColumn("__before", F.lag("__own").over(by)).where("NOT __m").drop("__b", "__m", "__carry", "__own")


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str], bucket: int = BUCKET_US) -> DataFrame:
    """``rows`` with each column of ``sums`` replaced by its sum over the key's rows up to each, by buckets as in ``lagged``."""
    per = rows.groupBy(*keys, _bucket(order[0], bucket).alias("__b")).agg(*(F.sum(c).alias(c) for c in sums))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    kind = "struct<" + ",".join(f"`{c}`:bigint" for c in sums) + ">"
    carried = F.when(F.count(F.lit(1)).over(earlier) > 0, F.struct(*(F.sum(c).over(earlier).cast("long").alias(c) for c in sums)))
    both = _marked(rows, keys, order, carried, per, kind, bucket)
    by = Window.partitionBy(*keys, "__b").orderBy(F.desc("__m"), *order).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumns({c: F.coalesce(F.col("__carry")[c], F.col(c)) for c in sums})
    return filled.withColumns({c: F.sum(c).over(by) for c in sums}).where("NOT __m").drop("__b", "__m", "__carry")


def counted_at(rows: DataFrame, points: DataFrame, key: str, time_us: str, sums: Sequence[str], bucket: int = BUCKET_US) -> DataFrame:
    """``points`` (key, at and other columns) with the sums of ``rows`` (key, time, ``sums``) of the key up to and at each point."""
    told = rows.select(key, F.col(time_us).alias("at"), *sums, F.lit(0).alias("__point"))
    asked = points.withColumns({c: F.lit(0).cast("long") for c in sums}).withColumn("__point", F.lit(1))
    both = asked.unionByName(told, allowMissingColumns=True)
    return running(both, [key], ["at", "__point"], sums, bucket).where("__point = 1").drop("__point")


def gaps(rows: DataFrame, keys: Sequence[str], time_us: str, tie: str) -> DataFrame:
    """Positive gaps in microseconds between consecutive rows of a key."""
    seen = lagged(rows.select(*keys, time_us, tie), keys, [time_us, tie])
    return seen.select(*keys, (F.col(time_us) - F.col("__before")[time_us]).alias("gap")).where("gap > 0")


def silence_threshold(median_gap_s: Column, n_gaps: Column, n: Column) -> Column:
    """Eight median gaps within the bounds; the ceiling for fewer than two gaps or three reports."""
    inside = F.greatest(F.lit(SILENCE_FLOOR), F.least(F.lit(SILENCE_CEILING), median_gap_s * SILENCE_GAPS))
    return F.when((n_gaps >= 2) & (n >= 3), inside).otherwise(SILENCE_CEILING)


def lifecycle(silence_s: Column, threshold_s: Column, n: Column, resolved: Column, had_impacts: Column) -> Column:
    """closed by record, closed by silence, quiescent or active."""
    return (
        F.when(n == 0, "candidate").when(resolved & ~had_impacts, "closed:resolution_record")
        .when((n >= 3) & (silence_s >= threshold_s * CLOSE_MULTIPLE), "closed:silence").when(silence_s >= threshold_s, "quiescent").otherwise("active")
    )


def grid_counts(rows: DataFrame, key: str, time_us: str, step_us: int, horizons: dict[str, int]) -> DataFrame:
    """(key, at, known, *horizons): a grid of ``step_us`` over each key's span, the rows up to each point and within each horizon after it.

    A row tells only the points that it changes: the first one that knows it and those that have it ahead, a horizon's
    length of them.  The points between have nothing ahead and know what the one before knows, so they are filled in
    last, where they are, and the grid itself is neither sorted nor joined."""
    rows = rows.select(key, F.col(time_us).alias("__t")).where(F.col(key).isNotNull() & F.col("__t").isNotNull())
    span = rows.groupBy(key).agg(F.min("__t").alias("__a"), F.max("__t").alias("__z"))
    # a merge: a table of keys that looks small in its file may not be so on the driver
    told = rows.join(span.hint("merge"), key).withColumn("__last", F.expr(f"(__z - __a) div {step_us}"))
    point = lambda back: f"greatest(0, (__t - __a - {back} + {step_us - 1}) div {step_us})"
    told = told.withColumn("__known", F.expr(point(0))).withColumn("__i", F.explode(F.sequence(F.expr(point(max([0, *horizons.values()]))), F.col("__known"))))
    ahead = lambda h: F.count_if((F.col("__i") < F.col("__known")) & (F.col("__t") <= F.col("__a") + F.col("__i") * step_us + h))
    per = told.where("__i <= __last").groupBy(key, "__a", "__last", "__i").agg(F.count_if(F.col("__i") == F.col("__known")).alias("known"), *(ahead(h).alias(name) for name, h in horizons.items()))
    by = Window.partitionBy(key).orderBy("__i")
    known = F.sum("known").over(by.rowsBetween(Window.unboundedPreceding, 0))
    until = F.coalesce(F.lead("__i").over(by) - 1, F.col("__last"))
    filled = per.select(key, "__a", "__i", known.alias("known"), *horizons, until.alias("__until")).withColumn("__j", F.explode(F.sequence("__i", "__until")))
    return filled.select(key, (F.col("__a") + F.col("__j") * step_us).alias("at"), "known", *(F.when(F.col("__j") == F.col("__i"), F.col(name)).otherwise(0).alias(name) for name in horizons))


def sessions(rows: DataFrame, keys: Sequence[str], time_us: str, tie: str, gap_us: int) -> DataFrame:
    """Adds session: it rises when a key is silent for longer than the gap."""
    seen = lagged(rows, keys, [time_us, tie])
    opens = F.when(F.col(time_us) - F.col("__before")[time_us] > gap_us, 1).otherwise(0).cast("long")
    return running(seen.withColumn("session", opens).drop("__before"), keys, [time_us, tie], ["session"])


def after_closure(rows: DataFrame, key: str, time_us: str, tie: str, silence_us: int, closes: Column) -> DataFrame:
    """The rows that follow a closed event, with outcome: ``reopened`` after silence alone, ``new`` where the row before the
    silence closed the event for good."""
    seen = lagged(rows.select(key, time_us, tie, closes.alias("closes")), [key], [time_us, tie], ["closes"])
    before = F.col("__before")
    seen = seen.select(key, time_us, tie, "closes", (F.col(time_us) - before[time_us]).alias("silence"), before["closes"].alias("closed"))
    return seen.where(F.col("silence") > silence_us).withColumn("outcome", F.when(F.col("closed"), "new").otherwise("reopened"))


def trend(early: Column, late: Column) -> tuple[Column, Column]:
    """Label and strength of the ratio of late to early counts."""
    ratio = F.when(early > 0, late / early).when(late > 0, 2.0).otherwise(1.0)
    label = F.when(ratio >= 1.5, "rising").when(ratio <= 0.67, "falling").otherwise("steady")
    strength = F.when(ratio >= 1.5, (ratio - 1) / 2).when(ratio <= 0.67, (F.lit(1.0) / F.greatest(ratio, F.lit(1e-6)) - 1) / 2).otherwise(F.abs(ratio - 1))
    return label, F.least(F.lit(1.0), strength)


def change_points(values: np.ndarray, least: int = 2) -> list[int]:
    """Optimal L2 segmentation with penalty 2 ln(n) var and pruning; ends of segments but the last, none for n < 8."""
    n = len(values)
    if n < 8:
        return []
    x = np.asarray(values, dtype=float)
    penalty = 2 * np.log(n) * max(float(x.var()), 1e-12)
    s, q = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(x * x)))
    best, back, open_ = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), [0]
    best[0] = -penalty
    for end in range(least, n + 1):
        starts = np.array([a for a in open_ if end - a >= least])
        cost = best[starts] + (q[end] - q[starts]) - (s[end] - s[starts]) ** 2 / (end - starts) + penalty
        k = int(cost.argmin())
        best[end], back[end] = cost[k], starts[k]
        drop = set(starts[cost > best[end] + penalty].tolist())
        open_ = [a for a in open_ if a not in drop] + ([end - least + 1] if end - least + 1 >= least else [])
    out, at = [], n
    while back[at] > 0:
        at = int(back[at])
        out.append(at)
    return out[::-1]


def detect_regimes(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, change_at, before, after): change points of each key's series, a group a task, values only."""
    kind = series.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        x = group[value].to_numpy()
        cuts = change_points(x)
        ends = [0, *cuts, len(x)]
        rows = [(group[key].iloc[0], c, float(x[ends[i]:c].mean()), float(x[c:ends[i + 2]].mean())) for i, c in enumerate(cuts)]
        return pd.DataFrame(rows, columns=[key, "change_at", "before", "after"])

    return series.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {kind}, change_at long, before double, after double")
