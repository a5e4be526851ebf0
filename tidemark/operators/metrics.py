"""An event's analysis as one nested record of ten dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx

# fixed values: the domain of each kind of report, severities by score, chances of disruption, the weights of confidence
DOMAINS = {"error": "road", "purchase": "transit", "signup": "utility"}
OTHER_DOMAIN = "facility"
SEVERITIES = ((75, "immediate"), (50, "high"), (25, "moderate"))
LIKELY, UNLIKELY = 0.85, 0.55
WEIGHTS = {"authority": 0.30, "corroboration": 0.25, "freshness": 0.15, "model": 0.20, "disagreement": -0.10}


def _day_rows(rows: DataFrame) -> DataFrame:
    """(event, day) with all sums that the record needs: the only pass over the reports, combined before it shuffles."""
    n = lambda when: F.count_if(when)
    kind, k = F.col("kind"), F.col("score")
    level = tx.ladder(k, list(SEVERITIES), "low")
    listed = {d: kind == name for name, d in DOMAINS.items()}
    other = ~kind.isin(*DOMAINS) | kind.isNull()
    return rows.groupBy("event", F.floor(F.col("us") / 86_400_000_000).cast("long").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.sum("lon").alias("lon"), F.sum("lat").alias("lat"), F.count("lon").alias("placed"),
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.sum("score").alias("score"),
        *(n(w).alias(d) for d, w in listed.items()), n(other).alias(OTHER_DOMAIN), *(n(level == s).alias(s) for s in ("immediate", "high", "moderate", "low")),
        F.sum("value").alias("value"), F.count("value").alias("valued"), F.max("value").alias("peak"), (F.bool_or(kind == "error") & F.bool_or(kind == "signup")).alias("disputed"),
        F.min_by("report", F.struct("us", "report")).alias("first_report"), F.max_by("report", F.struct("us", "report")).alias("last_report"),
    )


def analysis(rows: DataFrame, now_us: int) -> DataFrame:
    """(event, situation, infrastructure, traffic, transit, network, temporal, historical, prediction, confidence, delta,
    provenance) of reports (event, report, source, us, lon, lat, kind, score 0 to 100, value).

    A day's reports are a version of an event, its last day the present one.  Sums by event and day are combined before the
    shuffle and added up by event; sources are counted beside them, so no event's reports meet in one task.  Measures that have
    no input are null."""
    days = _day_rows(rows.where("event IS NOT NULL AND us IS NOT NULL"))
    names = [*DOMAINS.values(), OTHER_DOMAIN, "immediate", "high", "moderate", "low", "n", "lon", "lat", "placed", "score", "value", "valued"]
    last = lambda c: F.max_by(c, "day")
    per = days.groupBy("event").agg(
        *(F.sum(c).alias(c) for c in names), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("peak").alias("peak"),
        F.count(F.lit(1)).alias("version"), F.count_if("disputed").alias("disputed"), last("n").alias("n_now"), (last("value") / last("valued")).alias("speed_now"), last("transit").alias("transit_now"),
        F.min_by("first_report", "day").alias("first_report"), last("last_report").alias("last_report"),
    )
    sources = rows.where("event IS NOT NULL AND us IS NOT NULL").groupBy("event", "source").agg(F.lit(1)).groupBy("event").agg(F.count("source").alias("sources"))
    e = per.join(sources, "event")

    c = F.col
    r = lambda x, places=4: F.round(x, places)
    domains = [*DOMAINS.values(), OTHER_DOMAIN]
    first_most = F.element_at(F.array_sort(F.array(*(F.struct((-c(d)).alias("n"), F.lit(d).alias("d")) for d in domains))), 1)["d"]
    lon, lat = c("lon") / c("placed"), c("lat") / c("placed")
    radius = r(F.greatest(geo.haversine_m(lon, lat, c("west"), lat), geo.haversine_m(lon, lat, lon, c("south"))), 1)
    seconds = (c("last_us") - c("first_us")) / 1e6
    hours = r(seconds / 3600, 2)
    per_hour = lambda n: r(n / F.greatest(F.lit(0.1), F.when(hours > 0, hours).otherwise(0.5)), 2)
    rate, before = per_hour(c("n_now")), per_hour((c("n") - c("n_now")) / F.greatest(F.lit(1), c("version") - 1))
    previous = F.when(c("version") > 1, c("version") - 1)
    severest = F.when(c("immediate") > 0, "immediate").when(c("high") > 0, "high").when(c("moderate") > 0, "moderate").when(c("low") > 0, "low").otherwise("none")
    disrupted = r(((c("immediate") + c("high")) * LIKELY + (c("moderate") + c("low")) * UNLIKELY) / F.greatest(F.lit(1), c("n")))
    ratio = r(c("speed_now") / (c("value") / c("valued")))
    slower = F.when(ratio.isNotNull(), r(F.greatest(F.lit(0.0), 100 - ratio * 100), 1))
    delay = r(c("transit_now") * 1.5, 1)
    disagreement = r(F.least(F.lit(1.0), c("disputed") * 0.2))
    authority, corroboration = r((F.lit(0.0) + sum((c(d) > 0).cast("int") for d in domains)) / len(domains)), r(F.least(F.lit(1.0), c("sources") / 3.0))
    freshness = r(F.exp(-(F.lit(now_us) - c("last_us")) / 1e6 / 604_800))
    p_road = tx.sigmoid(F.least(F.lit(1.0), c("road") / 4.0) * 0.6 + authority * 0.8 - 2.6 + F.least(F.lit(1.0), c("peak") / 1000) * 0.9)
    model = r(c("score") / c("n") / 100)
    parts = {"authority": authority, "corroboration": corroboration, "freshness": freshness, "model": model, "disagreement": disagreement}
    composite = r(tx.clamp(sum((x * WEIGHTS[name] for name, x in parts.items()), F.lit(0.0)), 0.05, 1.0))
    named = lambda **fields: F.struct(*(x.alias(name) for name, x in fields.items()))
    counts = lambda of: F.map_from_arrays(F.array(*map(F.lit, of)), F.array(*(c(d) for d in of)))
    return e.select(
        "event",
        named(event_class=first_most, confidence=r(F.greatest(*(c(d) for d in domains)) / c("n")), lon=r(lon, 6), lat=r(lat, 6), radius_m=radius, footprint_m2=r(radius * radius * F.pi(), 1), growth_m2=r(rate * 150, 1), sources=c("sources"), agreement=r(F.greatest(F.lit(0.0), 1 - c("disputed") * 0.25))).alias("situation"),
        named(total=c("n"), by_domain=counts(domains), by_severity=counts(["immediate", "high", "moderate", "low"]), severest=severest, disruption=disrupted).alias("infrastructure"),
        named(speed=r(c("speed_now"), 1), usual=r(c("value") / c("valued"), 1), ratio=ratio, slower_percent=slower, congestion=F.when(ratio.isNull(), "not_analyzed").otherwise(tx.ladder(ratio, [(0.9, "normal"), (0.75, "minor"), (0.6, "moderate"), (0.4, "severe")], "gridlock"))).alias("traffic"),
        named(delay_min=delay, magnitude=F.when(delay > 15, "severe").when(delay > 5, "moderate").otherwise("minor"), cancelled=r(F.least(F.lit(0.95), c("transit_now") * 0.12 + 0.05)), minutes=r(F.greatest(F.lit(20.0), hours * 60), 1)).alias("transit"),
        named(affected=c("n"), overlaps=c("road"), reach=F.least(F.lit(3), c("sources")).cast("long"), open_share=r(1 - c("road") / c("n"))).alias("network"),
        named(first_us=c("first_us"), last_us=c("last_us"), age_s=r(seconds, 0).cast("long"), version=c("version"), previous=previous, rate=rate, trend=F.when(previous.isNull(), "steady").when(rate > before + 0.5, "accelerating").when(rate < before - 0.5, "decelerating").otherwise("steady"), expected_min=r(F.greatest(F.lit(30.0), hours * 60 + 45), 1)).alias("temporal"),
        named(daily=r(c("n") / c("version"), 2), deviation=r(c("n_now") - c("n") / c("version"), 2), duration_ratio=r(hours / 3.5, 2)).alias("historical"),
        named(p_road_60=r(p_road), p_road_15=r(p_road * 0.42), model=model).alias("prediction"),
        named(**parts, composite=composite).alias("confidence"),
        named(transition=F.concat(F.lit("v"), F.coalesce(previous, F.lit(0)).cast("string"), F.lit("->v"), c("version").cast("string")), fresh=c("n_now"), material=c("n_now") * 10 >= c("n"), magnitude=r(c("n_now") / c("n"))).alias("delta"),
        named(first_report=c("first_report"), last_report=c("last_report"), summary=F.format_string("%d reports from %d sources with %s peak severity", c("n"), c("sources"), severest)).alias("provenance"),
    )
