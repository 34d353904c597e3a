"""Rollups that can be merged: statistics with a quantile sketch per zone, pollutant and hour, joined to days and longer spans.

An hour's row holds number, mean, sum of squared deviations, least and largest value, a quantile sketch (KLL) and a sketch of the sensors
seen (HLL). Each has a bounded size, so neither a busy hour nor unrounded values make a buffer grow, and longer spans are made from stored
hours without reading measurements again.

Percentiles come with a stated rank error: the share of values below the value returned differs from the share asked for by at most
:func:`rank_error` in 99 of 100 cases; with fewer values than the sketch keeps, it is an exact order statistic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .panes import merged, part_of

#: Size parameter of the quantile sketches, and bits of the sketches of sensors.
KLL_K, HLL_BITS = 400, 14


def rank_error(k: int = KLL_K) -> float:
    """Published normalised rank error of one quantile of a KLL sketch, at 99 % confidence."""
    return 2.296 / k ** 0.9723


def hour_sketches(readings: DataFrame, keys: Sequence[str] = ("zone_id", "field"), every: str = "1 hour", k: int = KLL_K) -> DataFrame:
    """``(*keys, window_start, part, values, sensors)`` per window; null values are left out."""
    v = F.col("value").cast("double")
    g = readings.where(F.col("value").isNotNull()).groupBy(*keys, F.window("ts", every).alias("w")).agg(
        part_of(v).alias("part"), F.kll_sketch_agg_double(v, F.lit(k)).alias("values"), F.hll_sketch_agg(F.col("sensor_id").cast("string"), F.lit(HLL_BITS)).alias("sensors"))
    return g.select(*keys, F.col("w.start").alias("window_start"), "part", "values", "sensors")


def joined(sketches: DataFrame, keys: Sequence[str], window: Column, name: str = "window_start", k: int = KLL_K) -> DataFrame:
    """Rows of :func:`hour_sketches` joined to the longer ``window`` of each."""
    g = sketches.groupBy(*keys, window.alias(name)).agg(
        F.sort_array(F.collect_list(F.struct("window_start", "part"))).alias("p"),  # as many as windows in the longer one
        F.kll_merge_agg_double("values", F.lit(k)).alias("values"), F.hll_union_agg("sensors").alias("sensors"))
    return g.select(*keys, name, merged(F.transform("p", lambda x: x["part"])).alias("part"), "values", "sensors")


def quantile(values: Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(values, F.lit(share))


def columns(shares: Sequence[float] = (0.5, 0.95)) -> list[Column]:
    """The statistics of a row of sketches."""
    p = F.col("part")
    std = F.when(p["n"] > 1, F.sqrt(p["m2"] / (p["n"] - 1)))
    return [p["n"].alias("n"), p["mean"].alias("mean"), p["lo"].alias("min"), p["hi"].alias("max"), std.alias("stddev"),
            *[quantile(F.col("values"), s).alias(f"p{round(s * 100)}") for s in shares], F.hll_sketch_estimate("sensors").alias("sensor_count")]


def rank_checked(stats: DataFrame, readings: DataFrame, keys: Sequence[str], window: Column, shares: Sequence[float], allowed: float, name: str = "window_start") -> DataFrame:
    """``stats`` with ``p.._within``: whether the exact rank of each percentile is within ``allowed`` of the share asked for."""
    r = readings.where(F.col("value").isNotNull()).select(*keys, window.alias(name), F.col("value").alias("_v"))
    cols = {s: f"p{round(s * 100)}" for s in shares}
    q = stats.select(*keys, name, *cols.values())
    exact = r.join(q, [*keys, name]).groupBy(*keys, name).agg(
        F.count(F.lit(1)).alias("_n"), *[x for c in cols.values() for x in (F.count_if(F.col("_v") < F.col(c)).alias(f"_b_{c}"), F.count_if(F.col("_v") <= F.col(c)).alias(f"_a_{c}"))])
    ok = [((F.col(f"_b_{c}") <= (s + allowed) * F.col("_n")) & (F.col(f"_a_{c}") >= (s - allowed) * F.col("_n"))).alias(f"{c}_within") for s, c in cols.items()]
    return stats.join(exact.select(*keys, name, *ok), [*keys, name])
