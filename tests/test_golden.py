"""Hand-computed cases of the formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.functions import aqi, geo, text
from hazegrid.operators import detect, folds, forest, kriging, messages, windows


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_local_index(spark):
    got = column(spark, [0.0, 25.0, 40.0, 250.0, 500.0, 1000.0, None, -1.0], "double", aqi.local_pm25_index)
    assert got == [0, 50, 76, 200, 500, 500, None, None]


def test_epa_index(spark):
    got = column(spark, [6.0, 12.0, 35.4, 55.4, 600.0, None], "double", lambda c: aqi.epa_index_of(F.lit("pm25"), c))
    assert got == [25, 50, 100, 150, 500, 0]


@pytest.mark.parametrize("pollutant, c, want", [("pm25", 12.0, 50), ("pm25", 12.01, 51), ("pm25", 35.4, 100), ("pm25", 600.0, 500),
                                                ("no2", 1000.0, 500), ("o3", 200.0, 300), ("co", 50.0, 500)])
def test_daily_subindex(spark, pollutant, c, want):
    assert column(spark, [c], "double", lambda x: aqi.daily_subindex(pollutant, x)) == [want]


def test_level(spark):
    got = column(spark, [30, 180], "int", aqi.level)
    assert tuple(got[0]) == ("good", "Bon", "#00E400") and got[1]["level"] == "unhealthy"


def test_kalman(spark):
    df = spark.createDataFrame([(1, i, float(z)) for i, z in enumerate([10, 20])], "k int, i int, z double").withColumn(
        "ts", F.timestamp_seconds("i"))
    rows = folds.kalman(df, ["k"], "ts", "i", "z").orderBy("i").collect()
    assert [round(r.x, 6) for r in rows] == [10.0, 13.955556]
    assert [round(r.gain, 6) for r in rows] == [0.529412, 0.395556]
    assert [round(r["std"] ** 2, 6) for r in rows] == [2.117647, 1.582222]
    assert folds.kalman_gains(0.5, 4.0, 200)[-1][1] == pytest.approx(1.186140661634507)


def test_confidence(spark):
    got = column(spark, [math.sqrt(2.117647)], "double", lambda s: messages.confidence(s, F.lit(10.0)))
    assert got == [0.854]


def test_seq_dedup(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([1, 2, 2, 5, 4, 6])], "s string, i int, seq long").withColumn(
        "ts", F.timestamp_seconds(F.col("i") * 1800))
    assert [r.seq for r in windows.seq_dedup(df, "s", "seq", "ts", "i").orderBy("i").collect()] == [1, 2, 5, 6]


def test_cooldown(spark):
    df = spark.createDataFrame([("z", m) for m in [0, 10, 29, 30, 31, 59, 60, 61]], "z string, m int").withColumn(
        "ts", F.timestamp_seconds(F.col("m") * 60))
    got = folds.cooldown(df, ["z"], "ts", 1800).select((F.unix_timestamp("ts") / 60).cast("int").alias("m")).orderBy("m").collect()
    assert [r.m for r in got] == [0, 30, 60]


def test_drift(spark):
    df = spark.createDataFrame([("s", i, m, m) for i, m in enumerate([1.0, 1.1, 0.0, 1.0])], "sensor_id string, id int, coef_a double, coef_b double")
    df = df.withColumn("valid_from", F.timestamp_seconds(F.col("id") * 86400))
    assert [r.drift_pct for r in windows.calibration_drift(df).orderBy("id").collect()] == [0, 10, 100, 0]


def test_geo(spark):
    df = spark.range(1)
    km = df.select(geo.haversine_km(F.lit(14.7067), F.lit(-17.4520), F.lit(14.6937), F.lit(-17.4441))).first()[0]
    assert km == pytest.approx(1.6768, abs=1e-4)
    assert df.select(geo.circular_diff(F.lit(350.0), F.lit(10.0))).first()[0] == 20
    assert df.select(geo.azimuth(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))).first()[0] == pytest.approx(90)
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0))])
    inside = lambda x, y: df.select(geo.in_polygon(F.lit(x), F.lit(y), ring)).first()[0]
    assert inside(1.0, 0.5) and inside(3.5, 2.0) and not inside(2.0, 3.0) and not inside(5.0, 1.0)


def test_urgency(spark):
    def rule(c):
        return text.urgency(c, F.size(text.found(c, text.POLLUTANT_WORDS)))
    assert column(spark, ["incendie", "fumée et odeur", "bruit"], "string", rule) == ["high", "medium", "low"]


def test_slug_and_stale(spark):
    assert column(spark, ["ESP32-DK-MEDINA-001", "X-1"], "string", messages.slug_from_serial) == ["medina", "unknown"]
    at = lambda c: messages.stale(F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(c))
    assert column(spark, [300, 301], "int", at) == [False, True]


def test_thresholds(spark):
    df = spark.createDataFrame([(1, 1, "pm25", v) for v in (100.1, 50.1, 50.0)], "sensor_id int, zone_id int, field string, value double").withColumn(
        "ts", F.timestamp_seconds(F.lit(0)))
    assert [(r.detected_value, r.severity) for r in detect.threshold_findings(df).orderBy("detected_value").collect()] == [
        (50.1, "warning"), (100.1, "danger")]


def test_kriging_hits_stations(spark):
    lat = np.linspace(*kriging.LAT_RANGE, 200)[[10, 60, 150]]
    lon = np.linspace(*kriging.LON_RANGE, 200)[[20, 90, 180]]
    rows = [("a", i, float(a), float(o), v) for i, (a, o, v) in enumerate(zip(lat, lon, (12.0, 40.0, 25.0)))] + [("b", 9, 14.7, -17.4, 5.0)]
    s = spark.createDataFrame(rows, "k string, zone_id int, lat double, lon double, v double")
    fit = kriging.solve(s, ["k"], noise=1e-9)
    assert [r.k for r in fit.collect()] == ["a"]  # one station gives no result
    g = kriging.predict(fit, ["k"], noise=1e-9).where("(i, j) in ((10, 20), (60, 90), (150, 180))").orderBy("i").collect()
    assert [round(r.pm25, 4) for r in g] == [12.0, 40.0, 25.0] and all(r["std"] >= 0 for r in g)


def test_kriging_leave_one_out(spark):
    rng = np.random.default_rng(1)
    p, y = rng.uniform(0, 0.2, (6, 2)), rng.uniform(10, 50, 6)
    s = spark.createDataFrame([("a", i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(p, y))],
                              "k string, zone_id int, lat double, lon double, v double")
    got = kriging.solve(s, ["k"]).first().rmse_loo
    err = []
    for i in range(6):
        o = np.arange(6) != i
        k = np.exp(-((p[o][:, None] - p[o][None]) ** 2).sum(2) / (2 * 0.05**2)) + np.eye(5)
        ks = np.exp(-((p[i] - p[o]) ** 2).sum(1) / (2 * 0.05**2))
        err.append(y[o].mean() + y[o].std() * ks @ np.linalg.solve(k, (y[o] - y[o].mean()) / y[o].std()) - y[i])
    assert got == pytest.approx(float(np.sqrt(np.mean(np.square(err)))))


@pytest.mark.parametrize("trees, slack", [(40, 0.005), (3, 0.01)])  # rows shared by trees; rows drawn by hash share
def test_forest_flags_contamination(spark, trees, slack):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    model = forest.fit(df, ["a", "b", "c"], "id", trees=trees)
    share = model.score(df).select(F.avg((F.col("decision") < 0).cast("double"))).first()[0]
    assert abs(share - 0.03) <= slack
    out = spark.createDataFrame([(0, 9.0, 9.0, 9.0), (1, 0.0, 0.0, 0.0)], "id long, a double, b double, c double")
    far, near = [r.decision for r in model.score(out).orderBy("id").collect()]
    assert far < 0 < near
