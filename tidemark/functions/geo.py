"""Geography as column expressions; polygon predicates as Arrow-batched numpy."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# fixed values: earth radius and metres of a degree of latitude
EARTH_M = 6371008.8
DEGREE_M = 111320.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres; null for a missing coordinate."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a))) * (2 * EARTH_M)


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    dlon = F.radians(lon2 - lon1)
    x = F.sin(dlon) * F.cos(F.radians(lat2))
    y = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360, F.lit(360.0))


def cell(value: Column, metres: float, scale: float = DEGREE_M) -> Column:
    """Grid index of a coordinate in steps of ``metres``."""
    return F.floor(value * scale / metres).cast("long")


def geo_cell(lon: Column, lat: Column, metres: float = 750.0) -> Column:
    """``lat:lon`` key of the grid of ``metres``; longitude steps shrink with the row's latitude."""
    row = cell(lat, metres)
    return F.when(lon.isNull() | lat.isNull(), F.lit("nogeo")).otherwise(F.concat_ws(":", row.cast("string"), F.floor(lon * DEGREE_M * F.cos(F.radians(lat)) / metres).cast("long").cast("string")))


def point(lon: Column, lat: Column) -> Column:
    """A point, null for missing or (0, 0) coordinates."""
    island = (F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6)
    return F.when(lon.isNotNull() & lat.isNotNull() & ~island, F.struct(lon.alias("lon"), lat.alias("lat")))


def _geometry(kind: str, coordinates: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))


def point_json(lon: Column, lat: Column) -> Column:
    """GeoJSON of a point; null without a coordinate."""
    return F.when(lon.isNotNull() & lat.isNotNull(), _geometry("Point", F.array(lon, lat)))


def line_string(points: Column) -> Column:
    """GeoJSON of a line through an array of [lon, lat] arrays; null for fewer than two."""
    return F.when(F.size(points) >= 2, _geometry("LineString", points))


def polygon(rings: Column) -> Column:
    """GeoJSON of a polygon from an array of rings, the outer one first; rings are closed if they are not."""
    last = lambda ring: F.element_at(ring, -1)
    closed = F.transform(rings, lambda ring: F.when(F.element_at(ring, 1) == last(ring), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1))))
    return F.when(F.size(rings) >= 1, _geometry("Polygon", closed))


def bbox_polygon(box: dict[str, Column]) -> Column:
    """GeoJSON of a box (min_lon, min_lat, max_lon, max_lat)."""
    at = lambda x, y: F.array(box[f"{x}_lon"], box[f"{y}_lat"])
    return polygon(F.array(F.array(at("min", "min"), at("max", "min"), at("max", "max"), at("min", "max"))))


def bbox_overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["min_lon"] <= b["max_lon"]) & (b["min_lon"] <= a["max_lon"]) & (a["min_lat"] <= b["max_lat"]) & (b["min_lat"] <= a["max_lat"])


def area_m2(ring: Column) -> Column:
    """Shoelace area of a ring of (lon, lat) structs in local metres."""
    lat0 = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(ring)
    start = F.get(ring, F.lit(0))  # sums from the first corner, else small rings drown in their coordinates
    ring = F.transform(ring, lambda p: F.struct((p["lon"] - start["lon"]).alias("lon"), (p["lat"] - start["lat"]).alias("lat")))
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, turned, lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2 * DEGREE_M * DEGREE_M * F.cos(F.radians(lat0))


def _rings(geometry: str | None) -> list[np.ndarray]:
    if not geometry:
        return []
    g = json.loads(geometry)
    kind, c = g.get("type"), g.get("coordinates")
    if kind == "Point":
        return [np.array([c[:2]], dtype=float)]
    if kind in ("LineString", "MultiPoint"):
        return [np.array(c, dtype=float)[:, :2]]
    if kind in ("Polygon", "MultiLineString"):
        return [np.array(r, dtype=float)[:, :2] for r in c]
    if kind == "MultiPolygon":
        return [np.array(r, dtype=float)[:, :2] for part in c for r in part]
    return []


#: Tests of points against segments at once.
_AT_ONCE = 1 << 20


def _distances(px: np.ndarray, py: np.ndarray, rings: list[np.ndarray], closed: bool) -> np.ndarray:
    """Metres from points to all segments of one geometry, zero inside closed rings (even-odd rule)."""
    if not rings or not len(px):
        return np.full(len(px), np.inf)
    ends = [(r[:1], r[:1]) if len(r) == 1 else (r[:-1], r[1:]) for r in rings]
    start, end = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
    step = max(1, _AT_ONCE // len(start))
    if len(px) > step:
        return np.concatenate([_distances(px[at : at + step], py[at : at + step], rings, closed) for at in range(0, len(px), step)])
    kx = (DEGREE_M * np.cos(np.radians(py)))[:, None]
    x, y = (start[:, 0] - px[:, None]) * kx, (start[:, 1] - py[:, None]) * DEGREE_M
    dx, dy = (end[:, 0] - start[:, 0]) * kx, ((end[:, 1] - start[:, 1]) * DEGREE_M)[None, :]
    t = np.clip(-(x * dx + y * dy) / np.maximum(dx * dx + dy * dy, 1e-18), 0, 1)
    best = np.hypot(x + t * dx, y + t * dy).min(axis=1)
    if closed:
        over = (y > 0) != (y + dy > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = x - y * dx / dy
        best[(over & (cut > 0)).sum(axis=1) % 2 == 1] = 0.0
    return best


@F.pandas_udf(DoubleType())
def distance_to_geometry_m(lon: pd.Series, lat: pd.Series, geometry: pd.Series) -> pd.Series:
    """Metres from points to GeoJSON geometries; infinite for a missing geometry.  A batch's points of one geometry are tested
    together against all its segments."""
    out, x, y = np.full(len(lon), np.inf), lon.to_numpy(dtype=float), lat.to_numpy(dtype=float)
    for shape, at in geometry.groupby(geometry, sort=False).indices.items():
        out[at] = _distances(x[at], y[at], _rings(shape), "Polygon" in shape)
    return pd.Series(out, dtype=float)


def segments_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two segments (lon1, lat1, lon2, lat2) have a point in common, ends and overlaps included."""

    def side(s: dict[str, Column], x: Column, y: Column) -> Column:
        return F.signum((s["lon2"] - s["lon1"]) * (y - s["lat1"]) - (s["lat2"] - s["lat1"]) * (x - s["lon1"]))

    def boxes(c: str) -> Column:
        low, high = (lambda s: F.least(s[f"{c}1"], s[f"{c}2"])), (lambda s: F.greatest(s[f"{c}1"], s[f"{c}2"]))
        return F.greatest(low(a), low(b)) <= F.least(high(a), high(b))

    apart = lambda s, o: side(s, o["lon1"], o["lat1"]) * side(s, o["lon2"], o["lat2"])
    return boxes("lon") & boxes("lat") & (apart(b, a) <= 0) & (apart(a, b) <= 0)
