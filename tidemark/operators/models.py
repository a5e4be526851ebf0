"""Model registry and promotion: tables of models, champion and side outputs, a gate on calibrated error."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REGISTRY = "model_id string, task string, mode string, trained boolean, version int"


def listing(registry: DataFrame) -> DataFrame:
    """The registry with each model's place in its task, the champion first, then by id."""
    first = Window.partitionBy("task").orderBy(F.col("mode") != "champion", "model_id")
    return registry.withColumn("place", F.row_number().over(first).cast("long"))


def promote(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """The registry with each model of ``wanted`` (model_id, mode; one champion a task at most) in its new mode.

    An untrained model stays what it is; where a task gets a champion, the old one becomes a challenger."""
    taken = registry.where("trained").select("model_id", "task").join(wanted.withColumnRenamed("mode", "__new"), "model_id")
    champions = taken.where("__new = 'champion'").select("task", F.col("model_id").alias("__champion"))
    both = registry.join(taken.select("model_id", "__new"), "model_id", "left").join(champions, "task", "left")
    mode = F.when(F.col("__new").isNotNull(), F.col("__new")).when(F.col("__champion").isNotNull() & (F.col("mode") == "champion"), "challenger").otherwise(F.col("mode"))
    return both.select("model_id", "task", mode.alias("mode"), "trained", "version")


def outputs(registry: DataFrame, scored: DataFrame) -> DataFrame:
    """(task, key, p, model_id, mode, status): predictions of registered models; an untrained one answers ``model_required`` with
    no number."""
    rows = scored.join(registry, "model_id")
    return rows.select("task", "key", F.when(F.col("trained"), F.col("p")).alias("p"), "model_id", "mode", F.when(F.col("trained"), "ok").otherwise("model_required").alias("status"))


def evaluate_promotion(outcomes: DataFrame, candidate: str, champion: str, least_gain: float = 0.01, least_samples: int = 5) -> DataFrame:
    """(candidate_brier, champion_brier, samples, promote) over rows (model_id, key, p, y) that both models scored."""
    error = lambda m: F.avg(F.when(F.col("model_id") == m, F.pow(F.col("p") - F.col("y"), 2)))
    both = outcomes.where(F.col("model_id").isin(candidate, champion)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("__n = 2")
    r = both.agg(error(candidate).alias("candidate_brier"), error(champion).alias("champion_brier"), F.countDistinct("key").alias("samples"))
    gain = F.col("champion_brier") - F.col("candidate_brier") >= least_gain
    return r.withColumn("promote", F.coalesce(gain & (F.col("samples") >= least_samples), F.lit(False)))
