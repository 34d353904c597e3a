"""Anomaly detection rules (levels 1 and 3) and the union of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import cooldown

# fixed values: warning and danger limit per pollutant
THRESHOLDS = {"pm25": (50.1, 100.1), "pm10": (155.0, 255.0), "co": (9.5, 12.5), "no2": (101.0, 361.0), "o3": (71.0, 86.0)}
STUCK_STD, RATIO, MIN_POINTS, SEVERE_SCORE = 0.1, 1.5, 10, -0.15


def severity(score: Column) -> Column:
    return F.when(score < SEVERE_SCORE, "danger").otherwise("warning")


def threshold_of(pollutant: Column, which: int) -> Column:
    out = None
    for p, lim in THRESHOLDS.items():
        out = F.when(pollutant == p, lim[which]) if out is None else out.when(pollutant == p, lim[which])
    return out


def threshold_findings(readings: DataFrame) -> DataFrame:
    """Only the highest severity reached by each reading."""
    d = readings.withColumn("_w", threshold_of(F.col("field"), 0)).withColumn("_d", threshold_of(F.col("field"), 1))
    hit = F.col("value") >= F.col("_d")
    return d.where(F.col("value") >= F.col("_w")).select(
        "sensor_id", "zone_id", "ts", F.lit("threshold_exceeded").alias("type"), F.col("field").alias("pollutant"),
        F.when(hit, "danger").otherwise("warning").alias("severity"), F.col("value").alias("detected_value"),
        F.when(hit, F.col("_d")).otherwise(F.col("_w")).alias("threshold"), F.lit(None).cast("double").alias("score"))


def latest(readings: DataFrame, keys, ts: str = "ts", tie: str = "reading_id") -> DataFrame:
    """Newest row per key by one partial aggregate (no sort of whole keys)."""
    rest = [c for c in readings.columns if c not in keys]
    top = readings.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_r"))
    return top.select(*keys, "_r.*")


def look_back(readings: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    """The rows of the last ``hours`` up to ``now``."""
    return readings.where((F.col("ts") > now - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= now))


def stuck(window: DataFrame) -> DataFrame:
    """Sensors whose PM2.5 hardly moves; ``window`` holds the rows of the look-back time."""
    s = window.where(F.col("field") == "pm25").groupBy("sensor_id", "zone_id").agg(
        F.count("value").alias("n"), F.stddev_samp("value").alias("std"), F.avg("value").alias("mean"), F.max("ts").alias("ts"))
    return s.where((F.col("n") >= MIN_POINTS) & (F.col("std") < STUCK_STD)).select(
        "sensor_id", "zone_id", "ts", F.lit("stuck_sensor").alias("type"), F.lit("pm25").alias("pollutant"),
        F.lit("warning").alias("severity"), F.col("mean").alias("detected_value"), F.lit(STUCK_STD).alias("threshold"),
        F.lit(None).cast("double").alias("score"))


def implausible_ratio(window: DataFrame) -> DataFrame:
    """PM2.5 above 1.5 times PM10 in the newest row that has both, for sensors with enough rows.

    Rows are values of the same time; one time's values of a pollutant are averaged.
    """
    at = lambda f: F.avg(F.when(F.col("field") == f, F.col("value"))).alias(f)
    row = window.groupBy("sensor_id", "zone_id", "ts").agg(F.count("*").alias("n"), at("pm25"), at("pm10"))
    full = F.col("pm25").isNotNull() & F.col("pm10").isNotNull()
    s = row.groupBy("sensor_id", "zone_id").agg(F.sum("n").alias("n"), F.max_by(
        F.struct("pm25", "pm10", "ts"), F.when(full, F.col("ts"))).alias("r")).select("sensor_id", "zone_id", "n", "r.*")
    lim = F.col("pm10") * RATIO
    return s.where((F.col("n") >= MIN_POINTS) & (F.col("pm10") > 0) & (F.col("pm25") > lim)).select(
        "sensor_id", "zone_id", "ts", F.lit("implausible_ratio").alias("type"), F.lit("pm25").alias("pollutant"),
        F.lit("warning").alias("severity"), F.col("pm25").alias("detected_value"), lim.alias("threshold"),
        F.lit(None).cast("double").alias("score"))


def findings(*levels: DataFrame) -> DataFrame:
    out = levels[0]
    for l in levels[1:]:
        out = out.unionByName(l)
    return out


def alerts(found: DataFrame, seconds: int = 1800) -> DataFrame:
    """One alert per zone and cooldown, whatever the rule; it carries the gravest finding of its time."""
    sent = cooldown(found, ["zone_id"], "ts", seconds)
    gravest = found.groupBy("zone_id", "ts").agg(F.min_by(
        F.struct("type", "pollutant", "severity", "detected_value"), F.struct(F.col("severity") != "danger", "type", "pollutant", "sensor_id")).alias("f"))
    return sent.join(gravest, ["zone_id", "ts"]).select("zone_id", F.col("ts").alias("alert_at"), "f.*")
