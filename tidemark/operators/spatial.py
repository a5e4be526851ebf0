"""Range and spatial joins by grid cells, nearest neighbours, candidate generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .graph import kept


def _around(row: Column) -> Column:
    return F.array(row - 1, row, row + 1)


class _Cells:
    """Cells of a radius on the sphere: bands of latitude, each cut into its own number of columns round the globe.

    A point and any point at most the radius away lie in the same or adjacent bands, and within each band's grid in the
    same or adjacent columns, the last column next to the first."""

    def __init__(self, radius_m: float):
        angle = min(radius_m / geo.EARTH_M, math.pi) * (1 + 1e-9) + 1e-12
        self.step, self.half_chord = math.degrees(angle), math.sin(min(angle, math.pi) / 2)

    def band(self, lat: Column) -> Column:
        return F.floor(lat / self.step).cast("long")

    def columns(self, band: Column) -> Column:
        """How many columns a band has: each as wide as the radius where the band and its neighbours are nearest to a pole."""
        far = F.least(F.lit(90.0), F.greatest(F.abs(band - 1), F.abs(band + 2)) * self.step)
        half = F.lit(self.half_chord) / F.cos(F.radians(far))
        many = F.floor(F.lit(360.0) / (F.degrees(F.asin(half)) * 2 * (1 + 1e-9))).cast("long")
        return F.when((far < 90.0) & (half < 1.0), F.greatest(F.lit(1), many)).otherwise(F.lit(1)).cast("long")

    def column(self, lon: Column, band: Column) -> Column:
        n = self.columns(band)
        return F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n).cast("long"), n - 1)

    def own(self, rows: DataFrame, lon: str, lat: str) -> DataFrame:
        """Adds the cell (__y, __x) of each row."""
        rows = rows.withColumn("__y", self.band(F.col(lat)))
        return rows.withColumn("__x", self.column(F.col(lon), F.col("__y")))

    def copied(self, rows: DataFrame, lon: str, lat: str) -> DataFrame:
        """Each row once for its own and every adjacent cell."""
        rows = rows.withColumn("__y", F.explode(_around(self.band(F.col(lat)))))
        near = F.transform(_around(self.column(F.col(lon), F.col("__y"))), lambda x: F.pmod(x, self.columns(F.col("__y"))))
        return rows.withColumn("__x", F.explode(F.array_distinct(near)))


def within_distance(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of rows with columns lon, lat (renamed lon_r, lat_r on the right) at most ``radius_m`` apart, with dist_m.

    Both sides are put into cells of the radius; the right side is copied to the cells around it, so the join is an
    equi-join and no pair is met twice.  Holds near the poles and across 180 degrees.
    """
    cells = _Cells(radius_m)
    a = cells.own(left, "lon", "lat")
    b = cells.copied(right.withColumnsRenamed({"lon": "lon_r", "lat": "lat_r"}), "lon_r", "lat_r")
    dist = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("lon_r"), F.col("lat_r"))
    return a.join(b, ["__y", "__x"]).drop("__y", "__x").withColumn("dist_m", dist).where(F.col("dist_m") <= radius_m)


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, radius_m: float) -> DataFrame:
    """(key, right_key, dist_m): the nearest right row of each left row; ties go to the smaller key.

    Looks within ``radius_m`` and doubles it for the rows that found none, up to half the globe's girth, so cells stay
    small where neighbours are close; only a row without coordinates, or an empty right side, gets none."""
    order = F.struct("dist_m", right_key)
    pick = lambda pairs: pairs.groupBy(key).agg(F.min(order).alias("m")).select(key, F.col(f"m.{right_key}"), F.col("m.dist_m"))
    found, open_ = [], left.where("lon IS NOT NULL AND lat IS NOT NULL")
    while True:
        got = pick(within_distance(open_, right, radius_m))
        found.append(got)
        open_ = kept(open_.join(got.select(key), key, "left_anti"))
        if radius_m >= math.pi * geo.EARTH_M or open_.isEmpty():
            break
        radius_m *= 2
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def candidates(observations: DataFrame, events: DataFrame, margin_us: int, radius_m: float) -> DataFrame:
    """Observation-event pairs near in time and place: time buckets of the margin and cells of the radius joined as one key.

    Both need us, lon, lat; the events' come back as us_e, lon_e, lat_e, with dist_m and gap_us."""
    cells = _Cells(radius_m)
    bucket = lambda c: F.floor(c / margin_us).cast("long")
    o = cells.own(observations.withColumn("__t", bucket(F.col("us"))), "lon", "lat")
    e = events.withColumnsRenamed({"us": "us_e", "lon": "lon_e", "lat": "lat_e"})
    e = cells.copied(e.withColumn("__t", F.explode(_around(bucket(F.col("us_e"))))), "lon_e", "lat_e")
    gap, dist = F.abs(F.col("us") - F.col("us_e")), geo.haversine_m(F.col("lon"), F.col("lat"), F.col("lon_e"), F.col("lat_e"))
    pairs = o.join(e, ["__t", "__y", "__x"]).drop("__t", "__y", "__x").withColumns({"gap_us": gap, "dist_m": dist})
    return pairs.where((F.col("gap_us") <= margin_us) & (F.col("dist_m") <= radius_m))


def match_score(spatial: Column, temporal: Column, kind: Column, entity: Column, claims: Column, movement: Column) -> Column:
    """Weighted evidence that an observation belongs to an event (fixed values: the six weights)."""
    return spatial * 0.30 + temporal * 0.20 + kind * 0.15 + entity * 0.15 + claims * 0.12 + movement * 0.08


def decide(pairs: DataFrame, key: str, score: str, tie: str, corroborated: Column, merge: float = 0.62, review: float = 0.45) -> DataFrame:
    """The best candidate of each observation: match, possible or new."""
    best = pairs.groupBy(key).agg(F.max_by(F.struct(tie, score, corroborated.alias("ok")), F.struct(F.col(score), -F.col(tie))).alias("b"))
    s = F.col(f"b.{score}")
    return best.select(key, F.col(f"b.{tie}").alias(tie), s.alias(score), F.when((s >= merge) & F.col("b.ok"), "match").when(s >= review, "possible").otherwise("new").alias("decision"))


def contradictions(claims: DataFrame, subject: str, predicate: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Subjects whose claims on one predicate hold two values of a conflicting pair.

    Values are gathered as sets per subject and predicate, so no pair of claims is joined."""
    per = claims.groupBy(subject, predicate).agg(F.collect_set(value).alias("__v"))
    found = F.filter(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs)), lambda p: F.array_contains("__v", p["a"]) & F.array_contains("__v", p["b"]))
    return per.select(subject, predicate, F.explode(found).alias("__p")).select(subject, predicate, F.col("__p.a").alias("first"), F.col("__p.b").alias("second"))


def best_per(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key (a window group limit)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def meeting(left: DataFrame, right: DataFrame, left_id: str, right_id: str, step: float = 0.01) -> DataFrame:
    """(left_id, right_id) for each pair of segments (id, lon1, lat1, lon2, lat2) that have a point in common.

    Segments are copied to the cells of ``step`` degrees that their box covers and joined by cell; a pair is tested only in
    the cell of the least corner that both boxes share, so it comes once.  Choose ``step`` about the usual length, since a
    segment's copies grow with the square of its length in steps.  A segment with a null has no pairs."""
    names = ("lon1", "lat1", "lon2", "lat2")
    low = lambda s, c: F.floor(F.least(F.col(f"{s}{c}1"), F.col(f"{s}{c}2")) / step)
    high = lambda s, c: F.floor(F.greatest(F.col(f"{s}{c}1"), F.col(f"{s}{c}2")) / step)

    def dealt(rows: DataFrame, key: str, s: str) -> DataFrame:
        shown = rows.select(F.col(key).alias(f"{s}id"), *(F.col(n).alias(f"{s}{n}") for n in names)).dropna(subset=[f"{s}{n}" for n in names])
        return shown.withColumn("cx", F.explode(F.sequence(low(s, "lon"), high(s, "lon")))).withColumn("cy", F.explode(F.sequence(low(s, "lat"), high(s, "lat"))))

    pairs = dealt(left, left_id, "l_").join(dealt(right, right_id, "r_"), ["cx", "cy"])
    once = (F.col("cx") == F.greatest(low("l_", "lon"), low("r_", "lon"))) & (F.col("cy") == F.greatest(low("l_", "lat"), low("r_", "lat")))
    a, b = ({n: F.col(f"{s}{n}") for n in names} for s in ("l_", "r_"))
    return pairs.where(once & geo.segments_meet(a, b)).select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id))
