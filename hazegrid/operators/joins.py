"""Time and space joins built from equi-joins and ordered scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.timefeat import micros
from . import polygons
from .scan import HOUR, asof, numbered, running


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
            right_tie: Sequence[str], value: str, tolerance_s: int) -> DataFrame:
    """Value of the right row nearest in time within the tolerance; ties take the earlier row."""
    r = right.select(*keys, right_ts, *[c for c in right_tie if c not in (right_ts, *keys)],
                     F.col(right_ts).alias("_bt"), F.col(value).alias("_bv"))
    tie = [c for c in right_tie]
    b = asof(left, r, keys, left_ts, right_ts, tie, ["_bt", "_bv"])
    f = r.withColumnsRenamed({"_bt": "_ft", "_bv": "_fv"})
    both = asof(b, f, keys, left_ts, right_ts, tie, ["_ft", "_fv"], direction="forward")
    db = micros(F.col(left_ts)) - micros(F.col("_bt"))
    df_ = micros(F.col("_ft")) - micros(F.col(left_ts))
    lim = tolerance_s * 1_000_000
    pick_b = (db <= lim) & (df_.isNull() | (df_ > lim) | (db <= df_))
    return both.withColumn(value, F.when(pick_b, F.col("_bv")).when(df_ <= lim, F.col("_fv"))) \
        .drop("_bt", "_bv", "_ft", "_fv")


def interval_mean(left: DataFrame, left_id: str, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
                  value: str, seconds: int, out: str) -> DataFrame:
    """Mean of ``value`` over right rows in ``[t - seconds, t]`` of each left row (both ends closed).

    Time is cut into chunks as long as the interval. An interval is the end of one chunk and the beginning of the next,
    so it is one sum from a time to its chunk's end plus one from a chunk's begin to a time. Nothing is subtracted: values
    outside the interval, NaN or very large ones among them, have no part in its mean.
    """
    span = seconds * 1_000_000
    us = micros(F.col("_ts"))
    step = F.expr(f"INTERVAL '{seconds}' SECOND")
    lid = F.col(left_id).alias("_id")
    lo = left.select(*keys, lid, (F.col(left_ts) - step).alias("_ts"), F.lit(2).alias("_side"))
    hi = left.select(*keys, lid, F.col(left_ts).alias("_ts"), F.lit(3).alias("_side"))
    r = right.where(F.col(value).isNotNull()).select(
        *keys, F.col(right_ts).alias("_ts"), F.lit(1).alias("_side"), F.col(value).cast("double").alias("_v"))
    u = lo.unionByName(hi).unionByName(r, allowMissingColumns=True).withColumn("_c", F.floor(us / span))
    w = W.partitionBy(*keys, "_c")
    up = w.orderBy("_ts", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    down = w.orderBy(F.desc("_ts"), "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    u = u.select("_id", "_side", *[F.when(F.col("_side") == 3, f("_v").over(up)).otherwise(f("_v").over(down)).alias(n)
                                   for n, f in (("_s", F.sum), ("_n", F.count))])
    m = u.where(F.col("_side") > 1).groupBy("_id").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    mean = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    return left.join(m.select("_id", mean.alias(out)), left[left_id] == F.col("_id"), "left").drop("_id")


def zones_by_cell(zones: DataFrame, size: float, margin_lon: float | Column = 0.0, margin_lat: float = 0.0,
                  cols: Sequence[str] = ()) -> DataFrame:
    """Grid cells covered by each zone's box, with the zones of a cell as one array."""
    c = lambda x: geo.cell(x, size)
    z = zones.select(
        F.struct("zone_id", "niveau", "lon_c", "lat_c", "half", *cols).alias("z"),
        F.explode(F.sequence(c(F.col("lon_c") - F.col("half") - margin_lon),
                             c(F.col("lon_c") + F.col("half") + margin_lon))).alias("_cx"),
        F.col("lat_c"), F.col("half"))
    z = z.withColumn("_cy", F.explode(F.sequence(c(F.col("lat_c") - F.col("half") - margin_lat),
                                                 c(F.col("lat_c") + F.col("half") + margin_lat))))
    return z.groupBy("_cx", "_cy").agg(F.collect_list("z").alias("_zones"))


def in_zone_box(z: Column, lon: Column, lat: Column) -> Column:
    return geo.in_box(lon, lat, z["lon_c"] - z["half"], z["lat_c"] - z["half"],
                      z["lon_c"] + z["half"], z["lat_c"] + z["half"])


def locate(points: DataFrame, zones: DataFrame, pick: str = "smallest", out: str = "zone_id",
           size: float = 0.05) -> DataFrame:
    """Zone that contains each point: the smallest level-3 one, or the deepest of any level.

    Zones with a column ``rings`` are polygons (see :mod:`polygons`), others squares around ``lon_c, lat_c``.
    Points meet only the zones of their grid cell, held in one array per cell, so the join neither
    multiplies points nor needs an aggregation afterwards.
    """
    z = zones.where(F.col("niveau") == 3) if pick == "smallest" else zones
    if "rings" in zones.columns:
        best = polygons.smallest if pick == "smallest" else polygons.deepest
        return polygons.containing(points, z).withColumn(out, best(F.col("zones"))).drop("zones")
    cells = zones_by_cell(z, size)
    p = points.withColumn("_px", geo.cell(F.col("lon"), size)).withColumn("_py", geo.cell(F.col("lat"), size))
    j = p.join(cells, (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")), "left")
    inside = F.filter(F.col("_zones"), lambda s: in_zone_box(s, F.col("lon"), F.col("lat")))
    rank = (lambda s: s["half"]) if pick == "smallest" else (lambda s: -s["niveau"])
    best = F.array_min(F.transform(inside, lambda s: F.struct(rank(s).alias("r"), s["zone_id"].alias("zone_id"))))
    return j.withColumn(out, best["zone_id"]).drop("_px", "_py", "_cx", "_cy", "_zones")


def within_radius(points: DataFrame, point_id: str, zones: DataFrame, radius_km: float,
                  size: float = 0.05) -> DataFrame:
    """(point, zone, km) for every zone centroid within the radius of a point."""
    cells = zones_by_cell(zones.withColumn("half", F.lit(0.0)), size,
                          margin_lon=radius_km / (110.0 * F.cos(F.radians(F.abs("lat_c") + 1))), margin_lat=radius_km / 110.0)
    p = points.withColumn("_px", geo.cell(F.col("lon"), size)).withColumn("_py", geo.cell(F.col("lat"), size))
    j = p.join(cells, (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")))
    near = F.filter(
        F.transform(F.col("_zones"), lambda z: F.struct(
            z["zone_id"].alias("zone_id"),
            geo.haversine_km(F.col("lat"), F.col("lon"), z["lat_c"], z["lon_c"]).alias("km"))),
        lambda z: z["km"] <= radius_km)
    return j.select(*points.columns, F.explode(near).alias("_z")).select(
        *points.columns, F.col("_z.zone_id").alias("zone_id"), F.col("_z.km").alias("km"))


def spatiotemporal(reports: DataFrame, anomalies: DataFrame, zones: DataFrame, radius_km: float = 2.0,
                   before_s: int = 2 * HOUR, after_s: int = 1800, k: int = 10) -> DataFrame:
    """The ``k`` newest anomalies near each report in ``[t - before, t + after]``.

    Per near zone the number of the last anomaly at or before ``t + after`` is looked up as-of;
    only the ``k`` numbers ending there are fetched. A busy zone therefore costs ``k`` rows per
    report instead of all its anomalies.
    """
    a = numbered(anomalies.select(F.col("id").alias("anomaly_id"), F.col("zone_id"), "detected_at"),
                 ["zone_id"], "detected_at", ["detected_at", "anomaly_id"], "_n")
    r = within_radius(reports.select("report_id", "created_at", "lon", "lat"), "report_id", zones, radius_km)
    r = r.withColumn("_until", F.col("created_at") + F.expr(f"INTERVAL '{after_s}' SECOND"))
    hit = asof(r, a.select("zone_id", "detected_at", F.col("_n").alias("_last")), ["zone_id"], "_until", "detected_at",
               ["_last"], ["_last"])
    want = hit.where(F.col("_last").isNotNull()).select(
        "report_id", "created_at", "zone_id", "km",
        F.explode(F.sequence(F.greatest(F.col("_last") - (k - 1), F.lit(1)), F.col("_last"))).alias("_n"))
    m = want.join(a, ["zone_id", "_n"]).where(
        F.col("detected_at") >= F.col("created_at") - F.expr(f"INTERVAL '{before_s}' SECOND"))
    w = W.partitionBy("report_id").orderBy(F.col("detected_at").desc(), F.col("anomaly_id").desc())
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_n")


def zone_bearings(zones: DataFrame) -> DataFrame:
    """(zone, other zone, bearing) within a level. Zones are a reference table — a city's quarters —
    so this adjacency stays small however many measurements there are."""
    a = zones.select("zone_id", "niveau", "lon_c", "lat_c")
    b = zones.select(F.col("zone_id").alias("_z2"), "niveau", F.col("lon_c").alias("_x2"), F.col("lat_c").alias("_y2"))
    az = geo.azimuth(F.col("lon_c"), F.col("lat_c"), F.col("_x2"), F.col("_y2"))
    return a.join(b, "niveau").where(F.col("zone_id") != F.col("_z2")).select("zone_id", "_z2", az.alias("_az"))


def sector_mean(zones: DataFrame, wind: DataFrame, means: DataFrame, offset: float = 0.0, half_deg: float = 45.0,
                out: str = "upwind", keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the zone means within ``half_deg`` of the wind origin, per zone (and time ``keys``).

    ``wind`` and ``means`` hold one row per zone and key; measurements enter as such means only.
    """
    w = wind.select("zone_id", *keys, F.col("wind_direction").alias("_wd"))
    near = w.join(zone_bearings(zones), "zone_id").where(geo.circular_diff(F.col("_az"), F.col("_wd") + offset) <= half_deg)
    m = means.where(F.col("mean").isNotNull()).select(F.col("zone_id").alias("_z2"), *keys, "mean")
    return near.join(m, ["_z2", *keys]).groupBy("zone_id", *keys).agg(F.avg("mean").alias(out))


def silent(registered: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    return registered.join(fresh.select(key).distinct(), key, "left_anti")
