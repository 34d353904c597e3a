"""The six data-quality metrics, their limits, and post-deployment checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefeat import micros
from .supervise import hours, one_row

# fixed values: words of a quality alert; seconds between messages of a sensor; metric, side of the limit, limit, alert type
ALERT_TEXT = ("Pipeline quality alert: ", " (seuil ")
CYCLE_S = 30
LIMITS = (("Q1_coverage", "min", 0.80, "data_coverage_low"), ("Q2_calibration_rate", "min", 0.90, "calibration_rate_low"),
          ("Q3_rmse_1h", "max", 15.0, "prediction_rmse_high_1h"), ("Q4_rmse_24h", "max", 25.0, "prediction_rmse_high_24h"),
          ("Q5_false_alarm_rate", "max", 0.30, "false_alarm_rate_high"))


def coverage(points_last_hour: DataFrame, sensors: DataFrame) -> DataFrame:
    n = points_last_hour.agg(F.count("*").alias("_n"))
    s = sensors.agg(F.count_if(F.col("status") == "active").alias("_s"))
    return one_row([n, s]).select(
        F.round(F.try_divide(F.col("_n").cast("double"), F.col("_s") * (3600 // CYCLE_S)), 3).alias("q1_coverage"))


def calibration_rate(raw: DataFrame, cleansed: DataFrame) -> DataFrame:
    a, b = cleansed.agg(F.count("*").alias("_a")), raw.agg(F.count("*").alias("_b"))
    return one_row([a, b]).select(F.round(F.col("_a") / F.greatest(F.col("_b"), F.lit(1)), 3).alias("q2_calibration_rate"))


def rmse(predictions: DataFrame, horizons: Sequence[int]) -> DataFrame:
    e = F.abs(F.col("predicted_value") - F.col("actual_value"))
    return predictions.where(F.col("horizon_minutes").isin(*horizons) & F.col("actual_value").isNotNull()).groupBy(
        "horizon_minutes").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))


def false_alarm_rate(alerts: DataFrame) -> DataFrame:
    r = F.try_divide(F.count_if(F.col("statut_envoi") == "cancelled").cast("double"), F.count("*"))
    return alerts.agg(F.coalesce(r, F.lit(0.0)).alias("q5_false_alarm_rate"))


def latency_p95(readings: DataFrame, now: Column) -> DataFrame:
    """95th percentile of the age in whole milliseconds.

    Ages are counted per value first; a look-back window of bounded length has a bounded
    number of distinct ages, whatever the message rate.
    """
    age = F.floor((micros(now) - micros(F.col("ts"))) / 1000)
    by_age = readings.groupBy(age.alias("_ms")).agg(F.count("*").alias("_n"))
    return by_age.agg(F.percentile("_ms", 0.95, F.col("_n")).alias("q6_latency_p95_ms"))


def breaches(metrics: DataFrame, recent_alerts: DataFrame) -> DataFrame:
    """Metrics beyond their limit, unless an alert of the type was raised in the last hour.

    ``metrics`` holds one row with the metric columns, ``recent_alerts`` the ``alert_type`` of
    system alerts of the last hour.
    """
    rows = F.explode(F.array(*[F.struct(F.lit(kind).alias("alert_type"), F.lit(side).alias("side"), F.lit(limit).alias("limit"),
                                        F.col(m).cast("double").alias("value")) for m, side, limit, kind in LIMITS]))
    d = metrics.select(rows.alias("r")).select("r.*")
    bad = F.when(F.col("side") == "min", F.col("value") < F.col("limit")).otherwise(F.col("value") > F.col("limit"))
    msg = F.concat(F.lit(ALERT_TEXT[0]), "alert_type", F.lit(" = "), F.format_string("%.3f", "value"),
                   F.lit(ALERT_TEXT[1]), F.col("limit").cast("string"), F.lit(")"))
    return d.where(bad).join(recent_alerts.select("alert_type").distinct(), "alert_type", "left_anti").select(
        "alert_type", "value", "limit", msg.alias("message"))


def deploy_checks(readings: DataFrame, now: Column, spans: Sequence[int], limit: float) -> DataFrame:
    """Row counts per sensor, sensor and zone, zone and pollutant; zones whose newest PM2.5 is high."""
    s = lambda c: F.col(c).cast("string")
    pm = F.col("field") == "pm25"
    # one scan: every reading offers itself to the checks it is recent enough for
    marks = [F.when(F.col("ts") >= now - hours(h), F.struct(F.lit(n).alias("check_name"), key.alias("key"))) for n, h, key in zip(
        ("sensor", "sensor_zone", "zone_pollutant"), spans, (s("sensor_id"), F.concat_ws("/", s("sensor_id"), s("zone_id")), F.concat_ws("/", s("zone_id"), "field")))]
    marks.append(F.when(pm, F.struct(F.lit("zone_high").alias("check_name"), s("zone_id").alias("key"))))
    d = readings.select("ts", "value", F.explode(F.array_compact(F.array(*marks))).alias("m")).select("ts", "value", "m.*")
    g = d.groupBy("check_name", "key").agg(F.count("*").alias("n"), F.max_by("value", F.when(F.col("check_name") == "zone_high", F.col("ts"))).alias("v"))
    high = F.col("check_name") == "zone_high"
    return g.where(~high | (F.col("v") > limit)).select("check_name", "key", F.when(high, F.lit(1)).otherwise(F.col("n")).cast("long").alias("n"))
