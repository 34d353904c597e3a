"""Calibration, forecasting and evaluation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timefeat import micros
from .scan import numbered
from .supervise import attach

# fixed values: alert text of a forecast; linear fallback, forecast horizons in minutes, alert limits, fallback forecast
FORECAST_TEXT = ("PM2.5 prédit à ", " µg/m³ dans 1h")
FALLBACK_GAIN, FALLBACK_SHIFT = 0.85, 1.2
HORIZONS = {"h1": 60, "h6": 360, "h24": 1440}
FORECAST_DANGER, FORECAST_WARNING = 100.1, 50.1
THRESHOLD_FORECAST = {"h1": 30.0, "h6": 30.0, "h24": 30.0, "ci_lower_h1": 10.0, "ci_upper_h1": 80.0}
STEPS_PER_DAY = 288
RF_FEATURES = ("pm25_raw", "temperature", "humidity", "pressure", "hour")


def linear_calibration(raw: Column, a: Column | None = None, b: Column | None = None) -> Column:
    fixed = FALLBACK_GAIN * raw - FALLBACK_SHIFT
    return F.greatest(F.lit(0.0), fixed if a is None else F.coalesce(a * raw + b, fixed))


def active_coefficients(calibration: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("coef_a", "coef_b"), F.struct("valid_from", "id"))
    return calibration.groupBy("sensor_id").agg(newest.alias("c")).select("sensor_id", "c.*")


def forecast_fields(pred: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """One row per horizon: target time, bounds for the first hour, alert text above the limits."""
    rows = F.explode(F.array(*[F.struct(
        F.lit(m).alias("horizon_minutes"), F.col(h).alias("predicted_value"),
        (F.col("ci_lower_h1") if h == "h1" else F.lit(None).cast("double")).alias("ci_lower"),
        (F.col("ci_upper_h1") if h == "h1" else F.lit(None).cast("double")).alias("ci_upper")) for h, m in HORIZONS.items()]))
    d = pred.select(*keys, ts, rows.alias("r")).select(*keys, ts, "r.*")
    v, first = F.col("predicted_value"), F.col("horizon_minutes") == 60
    text = F.concat(F.lit(FORECAST_TEXT[0]), F.rint(v).cast("int").cast("string"), F.lit(FORECAST_TEXT[1]))
    return d.select("*", (F.col(ts) + F.make_dt_interval(mins=F.col("horizon_minutes"))).alias("target_timestamp"),
                    F.when(first & (v > FORECAST_DANGER), "danger").when(first & (v > FORECAST_WARNING), "warning").alias("gravite"),
                    F.when(first & (v > FORECAST_WARNING), text).alias("alert"))


def strategy(rows_per_zone: Column) -> Column:
    """Forecast method by the days of features a zone has."""
    days = rows_per_zone / float(STEPS_PER_DAY)
    return (F.when(days < 1, "threshold_fallback").when(days < 7, "seasonal").when(days < 30, "multi_horizon_light")
            .otherwise("multi_horizon_full"))


def degrade(method: Column, available: Sequence[str]) -> Column:
    """One step down at a time until a method whose model exists."""
    ladder = ["multi_horizon_full", "multi_horizon_light", "seasonal", "threshold_fallback"]
    out = F.lit("threshold_fallback")
    for m in reversed(ladder[:-1]):
        lower = next((x for x in ladder[ladder.index(m):] if x in available), "threshold_fallback")
        out = F.when(method == m, lower).otherwise(out)
    return out


def retrain_due(state: DataFrame, counts: DataFrame, limits: DataFrame, now: Column) -> DataFrame:
    """Models whose interval has passed and that have enough new points."""
    j = limits.join(state, "model", "left").join(counts, "model", "left")
    age_h = (micros(now) - micros(F.col("last_trained"))) / 3_600_000_000
    points = F.coalesce("new_points", F.lit(0))
    return j.withColumn("due", (F.col("last_trained").isNull() | (age_h >= F.col("interval_h"))) & (points >= F.col("min_points")))


def median_impute(df: DataFrame, keys: Sequence[str], cols: Sequence[str], how: str = "median") -> DataFrame:
    """Missing values become the median over all zones at the same time, or zero."""
    if how == "zero":
        return df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols})
    med = df.groupBy(*keys).agg(*[F.percentile(c, 0.5).alias(f"_m_{c}") for c in cols])
    return (df.join(med, list(keys)).withColumns({c: F.coalesce(c, f"_m_{c}") for c in cols})
            .drop(*[f"_m_{c}" for c in cols]))


def hourly_series(hours: DataFrame, least: int = 168) -> DataFrame:
    """``(zone_id, ds, y)`` of zones with at least ``least`` hours; ``hours`` has ``zone_id, hour, pm25``."""
    h = hours.select("zone_id", F.col("hour").alias("ds"), F.greatest(F.lit(0.0), "pm25").alias("y")).dropna()
    ok = h.groupBy("zone_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return h.join(ok, "zone_id", "left_semi")


def time_split(df: DataFrame, ts: str, order: Sequence[str], share: float = 0.85, keys: Sequence[str] = ()) -> DataFrame:
    """Mark the first ``share`` of the rows in time order as training rows.

    Without ``keys`` only the cut is looked for: rows are counted per hour, those of the hour that holds it per second, and
    so on down to one time, whose rows alone are numbered. With ``keys`` the rows of each key are numbered as ``rn``.
    """
    if keys:
        n = numbered(df, keys, ts, order, "rn")
        j = n.join(df.groupBy(*keys).agg(F.count("*").alias("_n")), list(keys))
        return j.withColumn("is_train", F.col("rn") <= F.floor(F.col("_n") * share)).drop("_n")
    us, lo, hi, left = micros(F.col(ts)), None, None, None
    for width in (3_600_000_000, 1_000_000, 1):
        part = F.floor(us / width).cast("long")
        here = df if lo is None else df.where((us >= lo) & (us < hi))
        counts = here.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # hours of the whole span, then at most an hour's seconds, a second's times
        if left is None:
            left = math.floor((counts.agg(F.sum("n")).first()[0] or 0) * share)
        before = counts.select("part", "n", F.sum("n").over(W.orderBy("part")).alias("upto")).where(F.col("upto") >= left).orderBy("part").limit(1).first()
        if before is None or left <= 0:
            return df.withColumn("is_train", F.lit(False))
        left -= before["upto"] - before["n"]
        lo, hi = before["part"] * width, (before["part"] + 1) * width
    at = us == lo
    last = df.where(at).orderBy(*order).limit(left).agg(F.max(F.struct(*order)).alias("_last"))
    return attach(df, last).withColumn("is_train", (us < lo) | (at & (F.struct(*order) <= F.col("_last")))).drop("_last")


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def scores(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """MAE, RMSE and R² in one pass."""
    e = F.col(prediction) - F.col(label)
    return pred.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                    (1 - F.sum(e * e) / (F.var_pop(label) * F.count(label))).alias("r2"))


def fit_calibration(train: DataFrame, trees: int = 150, depth: int = 12, seed: int = 42):
    rf = RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed, labelCol="pm25_true")
    return rf.fit(assemble(train, RF_FEATURES))


def apply_calibration(model, df: DataFrame) -> DataFrame:
    """Forest prediction on complete rows, linear fallback on the rest; never below 0."""
    missing = F.lit(False)
    for c in RF_FEATURES:
        missing = missing | F.col(c).isNull()
    if model is None:
        return df.withColumn("pm25", linear_calibration(F.col("pm25_raw"))).withColumn("method", F.lit("linear"))
    full = model.transform(assemble(df.where(~missing), RF_FEATURES))
    a = full.select(*df.columns, F.greatest(F.lit(0.0), "prediction").alias("pm25"), F.lit("forest").alias("method"))
    b = df.where(missing).select("*", linear_calibration(F.col("pm25_raw")).alias("pm25"), F.lit("linear").alias("method"))
    return a.unionByName(b)


def fourier(ts: Column) -> dict[str, Column]:
    """Daily (order 4), weekly (order 3) and yearly (order 5) terms."""
    day = micros(ts) / 86_400_000_000
    out = {}
    for name, period, order in (("d", 1.0, 4), ("w", 7.0, 3), ("y", 365.25, 5)):
        for k in range(1, order + 1):
            a = day * (2 * math.pi * k / period)
            out[f"{name}s{k}"], out[f"{name}c{k}"] = F.sin(a), F.cos(a)
    return out


def _seasonal_matrix(df: DataFrame, ts: str, origin: Column) -> tuple[DataFrame, list[str]]:
    f = {"trend": (micros(F.col(ts)) - micros(origin)) / 86_400_000_000, **fourier(F.col(ts))}
    return assemble(df.select("*", *[c.alias(n) for n, c in f.items()]), list(f)).drop(*f), list(f)


def fit_seasonal(train: DataFrame, ts: str, y: str, origin: Column):
    """Linear trend plus seasons as one ridge regression; residual deviation gives the bounds."""
    m, _ = _seasonal_matrix(train, ts, origin)
    model = LinearRegression(labelCol=y, regParam=0.01, elasticNetParam=0.0).fit(m)
    return model, model.summary.rootMeanSquaredError


def predict_seasonal(model, std: float, df: DataFrame, ts: str, origin: Column) -> DataFrame:
    m, _ = _seasonal_matrix(df, ts, origin)
    p = F.greatest(F.lit(0.0), "prediction")
    return model.transform(m).select(*df.columns, p.alias("predicted_value"),
                                     F.greatest(F.lit(0.0), p - 1.96 * std).alias("ci_lower"), (p + 1.96 * std).alias("ci_upper"))


def fit_multi_horizon(matrix: DataFrame, features: Sequence[str], targets: Sequence[str]):
    """One regression per target on the training part; deviation on the validation part."""
    out = {}
    for t in targets:
        m = assemble(matrix.where(F.col(t).isNotNull()), features)
        model = LinearRegression(labelCol=t, regParam=0.1).fit(m.where("is_train"))
        rmse = RegressionEvaluator(labelCol=t, metricName="rmse").evaluate(model.transform(m.where("not is_train")))
        out[t] = (model, rmse)
    return out


def predict_multi_horizon(models, df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    d = assemble(df, features)
    for t, (model, rmse) in models.items():
        p = F.greatest(F.lit(0.0), "prediction")
        d = model.transform(d).withColumns({t: p, f"{t}_lower": F.greatest(F.lit(0.0), p - 1.96 * rmse),
                                            f"{t}_upper": p + 1.96 * rmse}).drop("prediction")
    return d.select(*keys, *[c for t in models for c in (t, f"{t}_lower", f"{t}_upper")])


def scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero mean and unit (population) deviation; constant columns only lose their mean."""
    s = df.agg(*[F.avg(c).alias(f"_a_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    d = attach(df, s)
    return d.withColumns({c: (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
                          for c in cols}).drop(*[f"_{k}_{c}" for k in "as" for c in cols])


def backtest(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMSE and MAE of predictions whose actual value is known."""
    e = F.col("predicted_value") - F.col("actual_value")
    return predictions.where(F.col("actual_value").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
