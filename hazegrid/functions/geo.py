"""Points, boxes, polygons and grids as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dp, dl = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dp), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def azimuth(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Bearing on the lon/lat plane, 0 = north, clockwise, in [0, 360); null for equal points."""
    same = (lon1 == lon2) & (lat1 == lat2)
    return F.when(~same, F.pmod(F.degrees(F.atan2(lon2 - lon1, lat2 - lat1)) + 360.0, F.lit(360.0)))


def circular_diff(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def snap(x: Column, g: float) -> Column:
    return F.rint(x / g) * g


def in_box(lon: Column, lat: Column, xmin, ymin, xmax, ymax) -> Column:
    return lon.between(xmin, xmax) & lat.between(ymin, ymax)


def in_polygon(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting over ``ring``, an array of (lon, lat) structs without the closing point."""
    n = F.size(ring)

    def crosses(i):
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        x = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return F.when(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < x), 1).otherwise(0)

    hits = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crosses(i))
    return hits % 2 == 1


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def unit_hash(*cols) -> Column:
    """Repeatable number in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1_000_003)) / 1_000_003.0


def shifted(lon: Column, lat: Column, key: Column, jitter: float = 0.0005, grid: float = 0.001, tries: int = 20) -> Column:
    """Array of ``tries`` positions: snapped to the grid and shifted by at most ``jitter``.

    The shift is derived from ``key`` and the try number, so a rerun publishes the same point.
    """
    sx, sy = snap(lon, grid), snap(lat, grid)
    return F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda i: F.struct(
        (sx + (unit_hash(key, i, F.lit("x")) * 2 - 1) * jitter).alias("lon"),
        (sy + (unit_hash(key, i, F.lit("y")) * 2 - 1) * jitter).alias("lat")))


def anonymize_point(lon: Column, lat: Column, key: Column, inside, jitter: float = 0.0005,
                    grid: float = 0.001, tries: int = 20) -> Column:
    """The first shifted position for which ``inside(lon, lat)`` holds; when none does, the last one."""
    cand = shifted(lon, lat, key, jitter, grid, tries)
    ok = F.filter(cand, lambda p: inside(p["lon"], p["lat"]))
    return F.coalesce(F.get(ok, F.lit(0)), F.element_at(cand, -1))
