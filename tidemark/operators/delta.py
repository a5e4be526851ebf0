"""Change detection between consecutive versions: every detector is an optional row of one array, exploded once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values of the detectors
MATERIAL_FLOOR, SATURATION_M, CONFIDENCE_GAP, RATIO_NOISE = 0.12, 1200.0, 0.08, 0.05


def _row(when: Column, change: str, before: Column, after: Column, magnitude: Column) -> Column:
    text = lambda c: c.cast("string")
    return F.when(when, F.struct(F.lit(change).alias("change"), text(before).alias("before"), text(after).alias("after"), F.round(F.least(F.lit(1.0), magnitude), 6).alias("magnitude")))


def compare(states: DataFrame, key: str, version: str) -> DataFrame:
    """(key, version, change, before, after, magnitude) for states with status, label, authority, magnitude_value, moved_m, official.

    One window brings the version before; a first version is one ``created`` row; changes below the floor are dropped."""
    by = Window.partitionBy(key).orderBy(version)
    names = ("status", "label", "authority", "amount", "official")
    s = states.withColumns({f"p_{n}": F.lag(n).over(by) for n in names} | {"first": F.row_number().over(by) == 1})
    c, p = (lambda n: F.col(n)), (lambda n: F.col(f"p_{n}"))
    ratio = F.abs(c("amount") - p("amount")) / F.greatest(F.abs(p("amount")), F.lit(1e-9))
    old = ~F.col("first")
    found = F.array_compact(
        F.array(
            _row(F.col("first"), "created", F.lit(None), c("status"), F.lit(1.0)),
            _row(old & (c("status") != p("status")), "status", p("status"), c("status"), F.when(c("status") == "closed", 1.0).otherwise(0.55)),
            _row(old & (c("label") != p("label")), "classification", p("label"), c("label"), F.lit(0.5)),
            _row(old & (F.abs(c("authority") - p("authority")) >= CONFIDENCE_GAP), "confidence", F.round(p("authority"), 4), F.round(c("authority"), 4), F.abs(c("authority") - p("authority"))),
            _row(old & (ratio > RATIO_NOISE), "scale", F.round(p("amount"), 4), F.round(c("amount"), 4), ratio),
            _row(old & c("official") & ~p("official"), "guidance_issued", p("official"), c("official"), F.lit(1.0)),
            _row(old & ~c("official") & p("official"), "guidance_lapsed", p("official"), c("official"), F.lit(0.5)),
        )
    )
    return s.select(key, version, F.explode(found).alias("d")).select(key, version, "d.*").where(F.col("magnitude") >= MATERIAL_FLOOR)


def summarise(deltas: DataFrame, key: str, version: str) -> DataFrame:
    """The largest change of each version and how many there were."""
    return deltas.groupBy(key, version).agg(F.max("magnitude").alias("peak"), F.count(F.lit(1)).alias("changes"), F.max_by("change", F.struct("magnitude", "change")).alias("main"))


def displacement(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Share of the saturating distance that a centre moved; below 0.02, or with a place missing, it counts nothing."""
    share = _shift(lon1, lat1, lon2, lat2)
    return F.when(share < 0.02, 0.0).otherwise(share)


def _shift(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Share of the saturating distance; zero with a place missing."""
    from ..functions.geo import haversine_m

    return F.least(F.lit(1.0), F.coalesce(haversine_m(lon1, lat1, lon2, lat2), F.lit(0.0)) / SATURATION_M)


def _before(states: DataFrame, key: str, version: str, names: tuple[str, ...]) -> DataFrame:
    """Each version but the first with the columns ``names`` of the one before it as p_ columns."""
    by = Window.partitionBy(key).orderBy(version)
    return states.withColumns({f"p_{n}": F.lag(n).over(by) for n in names} | {"first": F.row_number().over(by) == 1}).where("NOT first")


def geometry(states: DataFrame, key: str, version: str) -> DataFrame:
    """(key, version, change, magnitude) where the centre (lon, lat) moved or the footprint (area in square metres) grew.

    A footprint is a union of reports, so modest growth is ordinary: either the shift or the growth must be notable (fixed
    values: the two floors and shares).  A missing place has not moved, a missing area is none."""
    s = _before(states.withColumn("area", F.coalesce("area", F.lit(0.0))), key, version, ("lon", "lat", "area"))
    shift = _shift(F.col("p_lon"), F.col("p_lat"), F.col("lon"), F.col("lat"))
    growth = F.when(F.col("p_area") > 0, F.greatest(F.lit(0.0), (F.col("area") - F.col("p_area")) / F.nullif("p_area", F.lit(0.0)))).otherwise(F.when(F.col("area") > 0, 1.0).otherwise(0.0))
    s = s.withColumns({"shift": shift, "growth": growth}).where("shift >= 0.02 OR growth >= 0.05")
    change = F.when(F.col("shift") >= F.col("growth"), "event_geometry_displaced").otherwise("event_footprint_expanded")
    return s.select(key, version, change.alias("change"), F.round(F.least(F.lit(1.0), F.col("shift") * 0.6 + F.least(F.lit(1.0), F.col("growth")) * 0.4), 4).alias("magnitude"))


def heading(states: DataFrame, key: str, version: str) -> DataFrame:
    """(key, version, change, magnitude) where movement (moving, direction in degrees or null) started, stopped or turned by over 30."""
    s = _before(states, key, version, ("moving", "direction"))
    same = (F.col("moving") == F.col("p_moving")) & F.col("direction").eqNullSafe(F.col("p_direction"))
    turned = F.abs(F.pmod(F.col("p_direction") - F.col("direction") + 180.0, F.lit(360.0)) - 180.0) > 30.0
    change = F.when(turned, "event_direction_changed").when(F.col("moving"), "movement_started").otherwise("movement_stopped")
    return s.where(~same).select(key, version, change.alias("change"), F.when(F.col("moving"), 0.7).otherwise(0.35).alias("magnitude"))


def breadth_magnitude(peak_rank: Column, count: Column) -> Column:
    """Magnitude of a set of impacts from the rank of its worst (0 none to 4 critical) and its number."""
    return F.round(F.least(F.lit(1.0), peak_rank / 4.0 * 0.7 + F.least(F.lit(1.0), count / 5.0) * 0.3), 4)
