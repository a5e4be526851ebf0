"""What an impact means to a user's way: which modes it concerns and the delay it causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the modes that an impact's domain concerns; domains not named concern all
MODES = {"transit": ("transit", "bus", "walk"), "road": ("drive", "bike", "walk", "transit")}


def mode_matches(domain: Column, modes: Column) -> Column:
    """Whether an impact of a domain concerns a user of these modes; a user without modes is concerned by all."""
    table = F.lit(True)
    for name, concerned in MODES.items():
        table = F.when(domain == name, F.arrays_overlap(modes, F.array(*map(F.lit, concerned)))).otherwise(table)
    return F.when(modes.isNull() | (F.size(modes) == 0), True).otherwise(table)


# fixed values: minutes of full exposure, the most that is said, and the weights of severity, breadth and prediction
DELAY_MIN, MOST_DELAY_MIN, DELAY_WEIGHTS = 25.0, 45.0, (0.6, 0.25, 0.15)


def delay_minutes(severity: Column, blocked: Column, predicted: Column) -> Column:
    """Delay of a way from its worst impact, the number that block it (three are full breadth) and their likeliest forecast."""
    parts = (severity, F.least(F.lit(1.0), blocked / 3.0), predicted)
    return F.least(F.lit(MOST_DELAY_MIN), sum((p * w for p, w in zip(parts, DELAY_WEIGHTS)), F.lit(0.0)) * DELAY_MIN)


def notification_reason(level: Column, official: Column, exposed: Column, new: Column, previous: Column, route: Column, impact: Column, status: Column) -> Column:
    """The first reason to tell a user: official guidance for one who is ``exposed`` to it, a new event, a level above the
    ``previous`` one, a route that is met, an impact or status that changed, else a change of place.  Null for a level of zero
    without official guidance."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when((level == 0) & ~yes(official), F.lit(None).cast("string")).when(yes(official) & yes(exposed), "official_guidance").when(yes(new), "new_event").when(yes(level > previous), "escalation")
        .when(yes(route), "route_change").when(yes(impact), "impact_change").when(yes(status), "status_change").otherwise("location_change")
    )


#: Impacts that a user is shown (a top-k, as the feature asks).
SHOWN_IMPACTS = 5


def presentations(users: DataFrame, impacts: DataFrame) -> DataFrame:
    """(user_id, item, ref, priority, rank): what each user is shown of ``impacts`` (user_id, impact_id, domain, severity 0 to 1,
    predicted), the most pressing first; equal priorities by item and reference (fixed values: the priorities).

    The worst impacts are kept by a window's group limit, so a user with very many leaves a few a task before the shuffle."""
    worst = Window.partitionBy("user_id").orderBy(F.desc("severity"), "impact_id")
    top = impacts.withColumn("__r", F.row_number().over(worst)).where(F.col("__r") <= SHOWN_IMPACTS)
    item = lambda name, ref, priority: F.struct(F.lit(name).alias("item"), ref.alias("ref"), F.round(priority, 4).cast("double").alias("priority"))
    of_impacts = top.select("user_id", item("impact", F.col("impact_id").cast("string"), F.least(F.lit(0.9), F.col("severity") * 0.5 + 0.35)).alias("i"))
    per = impacts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("predicted").alias("p"), F.count_if(F.col("domain") == "utility").alias("unsure"))
    p, none = F.col("p"), F.lit("")
    every = F.array_compact(F.array(
        F.when(F.col("n") > 0, item("route", none, F.least(F.lit(0.99), p * 0.3 + 0.7))), F.when(p >= 0.3, item("forecast", none, F.least(F.lit(0.8), p * 0.5 + 0.3))),
        F.when(F.col("n") > 0, item("evidence", F.concat(F.col("n").cast("string"), F.lit(" impacts")), F.lit(0.2))), F.when(F.col("unsure") > 0, item("uncertainty", F.concat(F.col("unsure").cast("string"), F.lit(" unconfirmed")), F.lit(0.15))),
        F.when(F.col("n").isNull(), item("quiet", none, F.lit(0.0))),
    ))
    shown = users.join(per, "user_id", "left").select("user_id", F.explode(every).alias("i")).unionByName(of_impacts).select("user_id", "i.*")
    return shown.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("priority"), "item", "ref")).cast("long"))
