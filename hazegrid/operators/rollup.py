"""Time-window statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(value: Column, exact: bool = True) -> dict[str, Column]:
    """The rollup statistics; ``q`` holds median and 95th percentile, from one buffer. ``exact=False`` swaps percentiles for a bounded-memory sketch."""
    q = F.percentile(value, [0.5, 0.95]) if exact else F.approx_percentile(value, [0.5, 0.95], 10000)
    return {"mean": F.avg(value), "min": F.min(value), "max": F.max(value), "stddev": F.stddev_samp(value), "q": q}


def rollup(readings: DataFrame, every: str, exact: bool = True, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per zone, pollutant and window: statistics and the number of sensors.

    One scan and one shuffle for all statistics; map-side combine leaves one partial per task and
    group, and an hour of readings holds few distinct values, which bounds the exact percentiles.
    """
    d = readings if fields is None else readings.where(F.col("field").isin(*fields))
    out = d.groupBy("zone_id", F.col("field").alias("pollutant"), F.window("ts", every).alias("w")).agg(
        *[c.alias(n) for n, c in stats(F.col("value"), exact).items()],
        F.count_distinct("sensor_id").alias("sensor_count"))
    return out.select("zone_id", "pollutant", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "mean", "min", "max", "stddev", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), "sensor_count")


def exceedance_hours(readings: DataFrame, limit: float = 15.0, pollutant: str = "pm25") -> DataFrame:
    hourly = (readings.where(F.col("field") == pollutant)
              .groupBy("zone_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("m")))
    return hourly.groupBy("zone_id", F.to_date("hour").alias("day")).agg(
        F.sum(F.when(F.col("m") > limit, 1).otherwise(0)).alias("exceedance_hours"))


def series(readings: DataFrame, every: str, keys: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """Windowed means, one column per field when ``fields`` is given, else long."""
    g = readings.groupBy(*keys, F.window("ts", every).alias("w"))
    if fields is None:
        out, cols = g.agg(F.avg("value").alias("mean")), ["mean"]
    else:
        out = g.agg(*[F.avg(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
        cols = list(fields)
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *cols)


def pivot(readings: DataFrame, keys: Sequence[str], fields: Sequence[str], agg=F.avg) -> DataFrame:
    """Long to wide with a fixed list of fields, so that no extra job looks the fields up."""
    return readings.groupBy(*keys).pivot("field", list(fields)).agg(agg("value"))


def per_minute(events: DataFrame, ts: str, now: Column, minutes: int = 60) -> DataFrame:
    """Messages per minute of the last ``minutes``, empty minutes as 0."""
    spark = events.sparkSession
    end = F.date_trunc("minute", now)
    spine = spark.range(1).select(F.explode(F.sequence(
        end - F.expr(f"INTERVAL '{minutes}' MINUTE"), end - F.expr("INTERVAL '1' MINUTE"),
        F.expr("INTERVAL '1' MINUTE"))).alias("minute"))
    counts = (events.where((F.col(ts) >= end - F.expr(f"INTERVAL '{minutes}' MINUTE")) & (F.col(ts) < end))
              .groupBy(F.date_trunc("minute", ts).alias("minute")).agg(F.count("*").alias("n")))
    return spine.join(counts, "minute", "left").select("minute", F.coalesce("n", F.lit(0)).alias("n"))
