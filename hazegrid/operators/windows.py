"""Row and time windows over sensor series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan


def hourly(readings: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Hourly means per zone, one column per field: the dense grid that hour lags work on."""
    return readings.where(F.col("field").isin(*fields)).groupBy(
        "zone_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        *[F.avg(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def hour_lags(h: DataFrame, lags: dict[str, Sequence[int]]) -> DataFrame:
    """Mean of the hour ``k`` hours earlier, null where that hour has no data.

    A range frame that covers exactly one hour replaces a self-join per lag; the input is already
    one row per zone and hour.
    """
    d = h.withColumn("_h", F.floor(F.unix_timestamp(F.col("hour").cast("timestamp")) / 3600).cast("long"))
    w = W.partitionBy("zone_id").orderBy("_h")
    return d.select("*", *[F.first(f).over(w.rangeBetween(-k, -k)).alias(f"{f}_lag_{k}h")
                           for f, ks in lags.items() for k in ks]).drop("_h")


def city_series(readings: DataFrame, every: str, fields: Sequence[str]) -> DataFrame:
    """One row per window over all zones; its length depends on the time span only."""
    g = readings.groupBy(F.window("ts", every).alias("w")).agg(
        *[F.avg(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    return g.select(F.col("w.start").alias("ts"), *fields)


def full(w: WindowSpec, n: int, agg: Column, of: Column) -> Column:
    """Aggregate over the last ``n`` rows, null until ``n`` values are there."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(of).over(f) == n, agg.over(f))


def seq_dedup(messages: DataFrame, sensor: str, seq: str, arrival: str, tie: str) -> DataFrame:
    """Keep a message iff its number is above every earlier number of the sensor (arrival order)."""
    d = scan.running(messages, [sensor], arrival, [arrival, tie], {"_top": ("max", F.col(seq))}, inclusive=False)
    return d.where(F.col("_top").isNull() | (F.col(seq) > F.col("_top"))).drop("_top")


def seq_gaps(messages: DataFrame, sensor: str, seq: str, ts: str, tie: str, modulus: int | None = None) -> DataFrame:
    """Missing number ranges between consecutive messages of a sensor, ordered by time."""
    d = scan.running(messages, [sensor], ts, [ts, tie], {"_prev": ("last", F.col(seq))}, inclusive=False)
    step = F.col(seq) - F.col("_prev")
    if modulus:
        step = F.pmod(step, F.lit(modulus))
    return d.where(step > 1).select(sensor, ts, (F.col("_prev") + 1).alias("gap_start"), (F.col(seq) - 1).alias("gap_end"),
                                    (step - 1).alias("size"))


def previous(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: Column, out: str, chunk_s: int = scan.HOUR) -> DataFrame:
    return scan.running(df, keys, ts, [ts, tie], {out: ("last", value)}, chunk_s, inclusive=False)


def calibration_drift(calibration: DataFrame) -> DataFrame:
    """Change in percent of the mean coefficient against the sensor's previous calibration."""
    c = calibration.withColumn("_m", (F.col("coef_a") + F.col("coef_b")) / 2)
    d = previous(c, ["sensor_id"], "valid_from", "id", F.col("_m"), "_p", chunk_s=30 * 24 * 3600)
    drift = F.when(F.col("_p").isNull() | (F.col("_p") == 0), 0.0).otherwise(F.abs(F.col("_m") - F.col("_p")) / F.abs("_p") * 100)
    return d.withColumn("drift_pct", F.round(drift, 3)).drop("_m", "_p")


def sequences(df: DataFrame, keys: Sequence[str], ts: str, features: Sequence[str], target: str, length: int,
              step: int) -> DataFrame:
    """Arrays of the ``length`` feature vectors before a row, with the row's target, every ``step`` rows.

    The array is built over blocks with a halo, and only kept rows carry one.
    """
    d = scan.row_windows(
        df, keys, ts, [ts],
        lambda w: {"sequence": F.when((F.col("rn") - 1 - length) % step == 0, F.collect_list(F.array(*features)).over(
            w.rowsBetween(-length, -1)))}, before=length)
    return d.where((F.col("rn") > length) & ((F.col("rn") - 1 - length) % step == 0)).select(*keys, ts, "rn", "sequence", target)
