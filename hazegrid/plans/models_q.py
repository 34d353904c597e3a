"""Calibration, forecasting, feature vectors and interpolation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import timefeat as tf
from ..functions.aqi import POLLUTANTS
from ..functions.geo import in_box
from ..operators import features, kriging, models, regress
from ..operators.joins import nearest
from ..operators.supervise import attach
from ..operators.windows import hour_lags, hourly
from ..session import cut
from .registry import query
from .scalars_q import AZ_SQL
from .views import now
from .windows_q import ANCHOR_SQL, LAG_SQL, ROLL_SQL, anchors, city, fill


def training_rows(t):
    """Hourly pairs per zone: raw and reference PM2.5 with weather."""
    h = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    r = t.v_readings.groupBy("zone_id", h).agg(F.avg("value").alias("pm25_raw"))
    w = t.v_weather.groupBy("zone_id", h).agg(*[F.avg(c).alias(c) for c in ("temperature", "humidity", "pressure")])
    d = r.join(w, ["zone_id", "ts"], "left").withColumn("hour", F.hour("ts"))
    return d.withColumn("pm25_true", 0.9 * F.col("pm25_raw") + 0.05 * F.coalesce("humidity", F.lit(65.0)))


def split(t):
    d = training_rows(t)
    return models.time_split(d, "ts", ["ts", "zone_id"])


@query("ml_calibration_rf")
def _(t):
    d = cut(split(t).dropna())
    model = models.fit_calibration(d.where("is_train"))
    return models.scores(model.transform(models.assemble(d.where("not is_train"), models.RF_FEATURES)), "pm25_true")


@query("ml_calibration_apply")
def _(t):
    d = training_rows(t)
    model = models.fit_calibration(d.dropna())
    return models.apply_calibration(model, d).select("zone_id", "ts", "pm25", "method")


@query("ml_scaler", """SELECT reading_id, round((value-m)/s,6) AS value FROM v_readings, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM v_readings)""")
def _(t):
    return models.scale(t.v_readings.select("reading_id", "value"), ["value"]).select("reading_id", F.round("value", 6).alias("value"))


GATE = (("calibration", 24, 2000), ("anomaly", 48, 5000), ("lstm", 24, 2016), ("prophet", 168, 168))  # fixed values


@query("ml_retrain_gate", """WITH l(model, field, interval_h, min_points) AS (VALUES ('calibration','pm25',24,2000),('anomaly','pm10',48,5000),('lstm','co',24,2016),('prophet','no2',168,168)),
c AS (SELECT field, count(*) AS n, min(ts) AS first FROM v_readings GROUP BY 1) SELECT model, n AS new_points, epoch($NOW-first)/3600 >= interval_h AND n >= min_points AS due FROM l JOIN c USING (field)""")
def _(t):
    name = F.when(F.col("field") == "pm25", "calibration").when(F.col("field") == "pm10", "anomaly").when(
        F.col("field") == "co", "lstm").when(F.col("field") == "no2", "prophet")
    g = t.v_readings.where(name.isNotNull()).groupBy(name.alias("model")).agg(F.count("*").alias("new_points"), F.min("ts").alias("last_trained"))
    limits = t.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(h).alias("interval_h"), F.lit(p).alias("min_points"))
                                                         for m, h, p in GATE])).alias("l")).select("l.*")
    return models.retrain_due(g.select("model", "last_trained"), g.select("model", "new_points"), limits, now()).select("model", "new_points", "due")


@query("ml_forecast_strategy", """SELECT zone_id, CASE WHEN n/288.0E0<1 THEN 'threshold_fallback' WHEN n/288.0E0<7 THEN 'seasonal' WHEN n/288.0E0<30 THEN 'seasonal' ELSE 'multi_horizon_full' END AS method FROM (SELECT zone_id, count(*) * (1 + zone_id * 2) AS n FROM v_features GROUP BY 1)""")
def _(t):
    n = t.v_features.groupBy("zone_id").agg((F.count("*") * (1 + F.col("zone_id") * 2)).alias("n"))
    m = models.degrade(models.strategy(F.col("n")), ["multi_horizon_full", "seasonal"])
    return n.select("zone_id", m.alias("method"))


@query("ml_threshold_forecast", "SELECT zone_id, 30.0E0 AS h1, 30.0E0 AS h6, 30.0E0 AS h24, 10.0E0 AS ci_lower_h1, 80.0E0 AS ci_upper_h1 FROM v_zones")
def _(t):
    return t.v_zones.select("zone_id", *[F.lit(v).alias(k) for k, v in models.THRESHOLD_FORECAST.items()])


def seasonal(t):
    s = cut(models.time_split(cut(city(t).select("ts", "pm25").dropna()), "ts", ["ts"]))
    origin = F.lit("2024-01-01").cast("timestamp_ntz")
    model, std = models.fit_seasonal(s.where("is_train").drop("is_train", "rn"), "ts", "pm25", origin)
    return s, model, std, origin


@query("ml_seasonal_forecast")
def _(t):
    s, model, std, origin = seasonal(t)
    steps = F.explode(F.array(*[F.lit(m) for m in models.HORIZONS.values()])).alias("horizon_minutes")
    f = s.agg(F.max("ts").alias("_last")).select("_last", steps).select(
        "horizon_minutes", (F.col("_last") + F.make_dt_interval(mins=F.col("horizon_minutes"))).alias("ts"))
    test = models.scores(models.predict_seasonal(model, std, s.where("not is_train").select("ts", "pm25"), "ts", origin), "pm25", "predicted_value")
    return attach(models.predict_seasonal(model, std, f, "ts", origin), test.select("rmse", "mae"))


def matrix_series(t):
    c = city(t)
    w = t.v_weather.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        *[F.avg(x).alias(x) for x in ("temperature", "humidity", "pressure", "wind_speed")])
    tr = t.v_traffic.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("congestion_level").alias("traffic_index"))
    return fill(c.join(w, "ts", "left").join(tr, "ts", "left"), ("temperature", "humidity", "pressure", "wind_speed", "traffic_index"))


@query("ml_multi_horizon")
def _(t):
    m = cut(models.time_split(cut(features.training_matrix(cut(matrix_series(t)))), "ts", ["ts"], 0.85))
    use = [c for c in m.columns if c not in ("ts", "rn", "is_train", "zone_elevation", *features.TARGET_ROWS)]
    fitted = models.fit_multi_horizon(m, use, list(features.TARGET_ROWS))
    return models.predict_multi_horizon(fitted, m.where("not is_train").drop(*features.TARGET_ROWS), use, ["ts"])


@query("ml_median_impute", """SELECT zone_id, ts, round(coalesce(pm25_rolling_mean_1h, median(pm25_rolling_mean_1h) OVER (PARTITION BY ts)),6) AS pm25, round(coalesce(no2_lag_1h,0),6) AS no2 FROM v_features""")
def _(t):
    f = t.v_features.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    d = models.median_impute(f, ["ts"], ["pm25_rolling_mean_1h"])
    d = models.median_impute(d, ["ts"], ["no2_lag_1h"], how="zero")
    return d.select("zone_id", "ts", F.round("pm25_rolling_mean_1h", 6).alias("pm25"), F.round("no2_lag_1h", 6).alias("no2"))


@query("ml_backtest", """WITH c AS (SELECT p.prediction_id, p.horizon_minutes, p.predicted_value, r.value, row_number() OVER (PARTITION BY p.prediction_id ORDER BY abs(epoch_us(r.ts)-epoch_us(p.target_timestamp)), r.ts, r.reading_id) AS rn
 FROM v_predictions p JOIN v_readings r ON r.zone_id=p.zone_id AND r.ts BETWEEN p.target_timestamp - INTERVAL 30 MINUTE AND p.target_timestamp + INTERVAL 30 MINUTE)
SELECT horizon_minutes, count(*) AS n, round(sqrt(avg(pow(predicted_value-value,2))),6) AS rmse, round(avg(abs(predicted_value-value)),6) AS mae FROM c WHERE rn=1 GROUP BY 1""")
def _(t):
    r = t.v_readings.withColumn("actual_value", F.col("value"))
    p = nearest(t.v_predictions.select("prediction_id", "zone_id", "horizon_minutes", "predicted_value", "target_timestamp"), r,
                ["zone_id"], "target_timestamp", "ts", ["reading_id"], "actual_value", 1800)
    return models.backtest(p, ["horizon_minutes"]).select("horizon_minutes", "n", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"))


@query("ml_backtest_zones", """WITH c AS (SELECT p.prediction_id, p.zone_id, p.horizon_minutes, p.predicted_value, r.value, row_number() OVER (PARTITION BY p.prediction_id ORDER BY abs(epoch_us(r.ts)-epoch_us(p.target_timestamp)), r.ts, r.reading_id) AS rn
 FROM v_predictions p JOIN v_readings r ON r.zone_id=p.zone_id AND r.ts BETWEEN p.target_timestamp - INTERVAL 30 MINUTE AND p.target_timestamp + INTERVAL 30 MINUTE)
SELECT zone_id, horizon_minutes, prediction_id % 3 AS model_id, count(*) AS n, round(sqrt(avg(pow(predicted_value-value,2))),6) AS rmse, round(avg(abs(predicted_value-value)),6) AS mae FROM c WHERE rn=1 GROUP BY 1,2,3""")
def _(t):
    r = t.v_readings.withColumn("actual_value", F.col("value"))
    p = nearest(t.v_predictions.select("prediction_id", "zone_id", "horizon_minutes", "predicted_value", "target_timestamp", (F.col("prediction_id") % 3).alias("model_id")), r,
                ["zone_id"], "target_timestamp", "ts", ["reading_id"], "actual_value", 1800)
    return models.backtest(p, ["zone_id", "horizon_minutes", "model_id"]).select("zone_id", "horizon_minutes", "model_id", "n", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"))


LAG_HOURS = (1, 2, 3, 6, 12, 24)
AHEAD = {"h1": 1, "h6": 6, "h24": 24}


def zone_series(t):
    """Hourly PM2.5 per zone with its lags and the values one, six and twenty-four hours ahead."""
    h = cut(hourly(t.v_readings, ["pm25"]))
    at = F.floor(F.unix_timestamp(F.col("hour").cast("timestamp")) / 3600).cast("long")
    w = Window.partitionBy("zone_id").orderBy(at)  # one row per zone and hour
    return hour_lags(h, {"pm25": LAG_HOURS}).select("*", *[F.first("pm25").over(w.rangeBetween(k, k)).alias(n) for n, k in AHEAD.items()])


def _ahead(k):
    return f"first(pm25) OVER (PARTITION BY zone_id ORDER BY hour RANGE BETWEEN INTERVAL {k} HOUR FOLLOWING AND INTERVAL {k} HOUR FOLLOWING)"


SERIES_SQL = """h AS (SELECT zone_id, date_trunc('hour',ts) AS hour, avg(value) AS pm25 FROM v_readings WHERE field='pm25' GROUP BY 1,2), l AS (SELECT zone_id, hour, pm25, """ + ", ".join(
    f"first(pm25) OVER (PARTITION BY zone_id ORDER BY hour RANGE BETWEEN INTERVAL {k} HOUR PRECEDING AND INTERVAL {k} HOUR PRECEDING) AS l{k}" for k in LAG_HOURS) + ", " + ", ".join(
    f"{_ahead(k)} AS {n}" for n, k in AHEAD.items()) + " FROM h)"


#: One regression per zone and horizon on the newest hour alone, which SQL can fit too.
@query("ml_zone_regression", f"WITH {SERIES_SQL} " + " UNION ALL ".join(
    f"SELECT zone_id, '{n}' AS target, CAST(regr_count({n}, pm25) AS BIGINT) AS n, round(regr_slope({n}, pm25),5) AS slope, round(regr_intercept({n}, pm25),4) AS intercept, round(sqrt(greatest(0, regr_syy({n}, pm25)/regr_count({n}, pm25)*(1-regr_r2({n}, pm25)))),4) AS rmse FROM l GROUP BY 1 HAVING regr_count({n}, pm25) >= 3"
    for n in AHEAD))
def _(t):
    f = regress.fit(zone_series(t), ["zone_id"], ["pm25"], list(AHEAD)).where("n >= 3")
    return f.select("zone_id", "target", "n", F.round(F.get("coefficients", F.lit(0)), 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("rmse", 4).alias("rmse"))


#: Forecasts of every zone from its own regression on lags and time of day; SQL has the rows that count and what must hold for the fit.
@query("ml_zone_forecast", f"WITH {SERIES_SQL}, z AS (SELECT zone_id % 5 AS g, * FROM l WHERE pm25 IS NOT NULL AND l1 IS NOT NULL) " + " UNION ALL ".join(
    f"SELECT g AS zone_group, '{n}' AS target, count(*) FILTER ({n} IS NOT NULL) AS n, count(*) AS forecasts, true AS normal_equations_hold, true AS bounds_hold FROM z GROUP BY 1 HAVING count(*) FILTER ({n} IS NOT NULL) >= 2" for n in AHEAD))
def _(t):
    d = zone_series(t).where("pm25 IS NOT NULL AND pm25_lag_1h IS NOT NULL").withColumn("zone_group", F.col("zone_id") % 5)  # the given series are sparse
    d = cut(d.select("*", *[c.alias(n) for n, c in tf.wave("hour", F.hour("hour"), 24).items()]))
    use = ["pm25", "pm25_lag_1h", "hour_sin", "hour_cos"]
    f = cut(regress.fit(d, ["zone_group"], use, list(AHEAD), ridge=0.1))
    p = regress.predict(d, f, ["zone_group"], use, ["zone_group", "zone_id", "hour"])
    n = p.groupBy("zone_group", "target").agg(F.count("predicted_value").alias("forecasts"), F.bool_and((F.col("ci_lower") <= F.col("predicted_value")) & (
        F.col("predicted_value") <= F.col("ci_upper"))).alias("bounds_hold"))
    return f.select("zone_group", "target", "n", (F.col("gradient") < 1e-8).alias("normal_equations_hold")).join(n, ["zone_group", "target"])


RAW_ROLL = ROLL_SQL.replace('round(', '(').replace('+1e-9,4) AS', ') AS')
NOW5 = ", ".join(f"coalesce({p},0) AS {p}" for p in POLLUTANTS)
#: Features in groups: columns that the SQL below computes as given, and those it rounds.
VEC_PLAIN = ("is_weekend is_rush_hour is_night is_morning is_evening is_business_hour temperature humidity pressure wind_direction precipitation congestion_level "
             "congestion_lag_1h sensor_density battery_level sensor_age_days days_since_calibration").split()
VEC_EXPR = {
    **{f"{f}_lag_{k}h": f"{f}_lag_{k}h" for f, ks in features.HOUR_LAGS.items() for k in ks},
    **{c: c for c in [f"pm25_rolling_mean_{features.label(k)}" for k in features.MEAN_HOURS] + [f"pm25_rolling_std_{k}h" for k in features.STD_HOURS]
       + [f"pm25_rolling_{s}_{k}h" for k in features.MIN_MAX_HOURS for s in ("min", "max")] + ["pm25_rolling_median_6h", "pm25_rolling_p95_24h"]
       + [f"pm10_rolling_mean_{k}h" for k in features.PM10_MEAN_HOURS]},
    **{f"pm25_delta_{k}h": f"nw.pm25-pm25_lag_{k}h" for k in (1, 3, 6, 12)},
    "pm25_accel_1h": "(nw.pm25-pm25_lag_1h)-(pm25_lag_1h-pm25_lag_6h)", "pm25_daily_change_pct": "CASE WHEN pm25_lag_24h>0 THEN (nw.pm25-pm25_lag_24h)/pm25_lag_24h*100 END",
    **{f"{n}_{f}": f"{f}(2*pi()*{x}/{p})" for n, x, p in (("hour", "(hour(a.t)+minute(a.t)/60.0E0)", 24), ("day_of_week", "(isodow(a.t)-1)", 7), ("month", "month(a.t)", 12)) for f in ("sin", "cos")},
    "wind_speed": "wind_speed", "wind_dir_sin": "sin(radians(wind_direction))", "wind_dir_cos": "cos(radians(wind_direction))",
    "temp_hum_index": "0.8E0*temperature+humidity*temperature/500", "dew_point": "temperature-(100-humidity)/5", "congestion_rolling_mean_3h": "congestion_rolling_mean_3h",
    **{n: f"CASE WHEN nw.{d}>0 THEN nw.{x}/nw.{d} END" for n, x, d in tf.RATIOS},
    "pm25_neighbor_mean": "pm25_rolling_mean_1h", "pm25_upwind_mean": "up", "pm25_downwind_mean": "down", "pm25_city_mean": "city",
    "wind_independence_index": "CASE WHEN nw.pm25>0 AND up>0 THEN abs(nw.pm25-up)/greatest(nw.pm25,up) WHEN wind_speed<0.5E0 THEN 1 END",
    "pm25_spatial_gradient": "(nw.pm25-ro.pm25_rolling_mean_1h)/greatest(nw.pm25,1)"}


def vec_sql(anchor_sql):
    """All 81 features by plain joins of anchors and rows."""
    return f"""WITH {anchor_sql}, rd AS (SELECT * FROM v_readings),
h AS (SELECT zone_id, date_trunc('hour',ts) AS hour, {', '.join(f"avg(value) FILTER (field='{p}') AS {p}" for p in POLLUTANTS)} FROM rd GROUP BY 1,2),
sp AS (SELECT zone_id, hour FROM h UNION SELECT zone_id, date_trunc('hour', t) FROM a), hs AS (SELECT * FROM sp LEFT JOIN h USING (zone_id, hour)),
lg AS (SELECT zone_id, hour, {LAG_SQL.replace('round(', '(').replace(',6) AS', ') AS')} FROM hs),
ro AS (SELECT a.zone_id, a.t, {RAW_ROLL} FROM a LEFT JOIN rd r ON r.zone_id=a.zone_id AND r.ts >= a.t - INTERVAL 168 HOUR AND r.ts < a.t GROUP BY 1,2),
n1 AS (SELECT a.zone_id, a.t, {', '.join(f"avg(value) FILTER (field='{p}') AS {p}" for p in POLLUTANTS)} FROM a LEFT JOIN rd r ON r.zone_id=a.zone_id AND r.ts >= a.t - INTERVAL 1 HOUR AND r.ts < a.t GROUP BY 1,2),
nw AS (SELECT zone_id, t, pm25 AS pm25_raw, {NOW5} FROM n1),
wx AS (SELECT a.zone_id, a.t, w.* EXCLUDE (zone_id, ts) FROM a ASOF LEFT JOIN v_weather w ON a.zone_id=w.zone_id AND a.t>=w.ts),
tr AS (SELECT a.zone_id, a.t, x.congestion_level, y.congestion_level AS congestion_lag_1h FROM (SELECT *, t - INTERVAL 1 HOUR AS t1 FROM a) a ASOF LEFT JOIN v_traffic x ON a.zone_id=x.zone_id AND a.t>=x.ts ASOF LEFT JOIN v_traffic y ON a.zone_id=y.zone_id AND a.t1>=y.ts),
ti AS (SELECT a.zone_id, a.t, avg(congestion_level) AS congestion_rolling_mean_3h FROM a LEFT JOIN v_traffic w ON w.zone_id=a.zone_id AND w.ts BETWEEN a.t - INTERVAL 3 HOUR AND a.t GROUP BY 1,2),
pr AS (SELECT a.zone_id, b.zone_id AS z2, {AZ_SQL.format(x1='a.lon_c', y1='a.lat_c', x2='b.lon_c', y2='b.lat_c')} AS az FROM v_zones a JOIN v_zones b ON a.zone_id<>b.zone_id),
se AS (SELECT wx.zone_id, wx.t, avg(nw.pm25_raw) FILTER (abs(fmod(az-wind_direction+180+720,360)-180)<=45) AS up, avg(nw.pm25_raw) FILTER (abs(fmod(az-(wind_direction+180)+180+720,360)-180)<=45) AS down FROM wx JOIN pr USING (zone_id) JOIN nw ON nw.zone_id=pr.z2 AND nw.t=wx.t GROUP BY 1,2),
ci AS (SELECT t, avg(value) AS city FROM (SELECT DISTINCT t FROM a) a JOIN rd r ON r.ts >= a.t - INTERVAL 1 HOUR AND r.ts < a.t WHERE field='pm25' GROUP BY 1),
sd AS (SELECT zone_id, count(*) FILTER (status='active') AS sensor_density, min(sensor_id) FILTER (status='active') AS first FROM v_sensors GROUP BY 1),
sm AS (SELECT zone_id, sensor_density, CAST(first % 101 AS DOUBLE) AS battery_level, DATE '2023-01-01' + CAST(first % 300 AS INTEGER) AS installed FROM sd),
f AS (SELECT a.zone_id, a.t, CASE WHEN isodow(a.t)>=6 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN hour(a.t) IN (7,8,9,17,18,19) THEN 1 ELSE 0 END AS is_rush_hour, CASE WHEN hour(a.t)>=22 OR hour(a.t)<=5 THEN 1 ELSE 0 END AS is_night,
 CASE WHEN hour(a.t) BETWEEN 6 AND 10 THEN 1 ELSE 0 END AS is_morning, CASE WHEN hour(a.t) BETWEEN 17 AND 21 THEN 1 ELSE 0 END AS is_evening, CASE WHEN hour(a.t) BETWEEN 8 AND 17 AND isodow(a.t)<6 THEN 1 ELSE 0 END AS is_business_hour,
 temperature, humidity, pressure, wind_direction, precipitation, congestion_level, congestion_lag_1h, sensor_density, battery_level,
 CAST(date_diff('day', installed, CAST(a.t AS DATE)) AS INTEGER) AS sensor_age_days, CAST(CASE WHEN installed IS NOT NULL THEN date_diff('day', DATE '2023-12-01', CAST(a.t AS DATE)) END AS INTEGER) AS days_since_calibration,
 {', '.join(f'round({x}+1e-9,4) AS {n}' for n, x in VEC_EXPR.items())}
FROM a JOIN nw USING (zone_id,t) JOIN lg ON lg.zone_id=a.zone_id AND lg.hour=date_trunc('hour',a.t) JOIN ro ON ro.zone_id=a.zone_id AND ro.t=a.t LEFT JOIN wx ON wx.zone_id=a.zone_id AND wx.t=a.t LEFT JOIN tr ON tr.zone_id=a.zone_id AND tr.t=a.t
 LEFT JOIN ti ON ti.zone_id=a.zone_id AND ti.t=a.t LEFT JOIN se ON se.zone_id=a.zone_id AND se.t=a.t LEFT JOIN ci ON ci.t=a.t LEFT JOIN sm ON sm.zone_id=a.zone_id)
SELECT * FROM f"""


def sensor_meta(t):
    s = t.v_sensors.where(F.col("status") == "active").groupBy("zone_id").agg(F.min("sensor_id").alias("sensor_id"))
    return s.select("zone_id", F.date_add(F.lit("2023-01-01").cast("date"), (F.col("sensor_id") % 300).cast("int")).alias("install_date"),
                    F.lit("2023-12-01").cast("date").alias("last_calibration"), (F.col("sensor_id") % 101).cast("double").alias("battery_level"))


def vector(t, at):
    v = features.zone_vector(t.v_readings, t.v_zones, t.v_sensors, t.v_weather, t.v_traffic, sensor_meta(t), at)
    if len(v.columns) != len(VEC_PLAIN) + len(VEC_EXPR) + 2:
        raise ValueError(f"{len(v.columns) - 2} features")
    return v.select("zone_id", "t", *VEC_PLAIN, *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in VEC_EXPR])


@query("feat_zone_vector", vec_sql(ANCHOR_SQL))
def _(t):
    return vector(t, anchors(t))


#: Every zone at times between full hours and between panes.
ODD_SQL = "a AS (SELECT zone_id, t FROM (SELECT DISTINCT zone_id FROM v_zones), generate_series(TIMESTAMP '2024-01-01 05:07:21', TIMESTAMP '2024-01-31', INTERVAL 427 MINUTE) g(t))"


def odd_anchors(t):
    times = F.sequence(F.lit("2024-01-01 05:07:21").cast("timestamp_ntz"), now(), F.expr("INTERVAL '427' MINUTE"))
    return t.v_zones.select("zone_id", F.explode(times).alias("t"))


@query("feat_zone_vector_any_time", vec_sql(ODD_SQL))
def _(t):
    return vector(t, odd_anchors(t))


@query("win_rolling_any_time", f"WITH {ODD_SQL} SELECT a.zone_id, a.t, {ROLL_SQL} FROM a LEFT JOIN v_readings r ON r.zone_id=a.zone_id AND r.ts >= a.t - INTERVAL 168 HOUR AND r.ts < a.t GROUP BY 1,2")
def _(t):
    r = features.rolling_at(features.panes_of(t.v_readings), odd_anchors(t))
    return r.select("zone_id", "t", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in r.columns if "rolling" in c])


W = "OVER (ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
def _lag(x, k):
    return f"lag({x},{k}) OVER (ORDER BY ts)"


MAT_ROLL = (("mean_1h", 12, "avg"), ("std_1h", 12, "stddev_samp"), ("mean_3h", 36, "avg"), ("std_3h", 36, "stddev_samp"), ("mean_6h", 72, "avg"), ("mean_12h", 144, "avg"), ("mean_24h", 288, "avg"),
            ("min_3h", 36, "min"), ("max_3h", 36, "max"), ("min_24h", 288, "min"), ("max_24h", 288, "max"), ("median_3h", 36, "median"))
#: All 57 features and 3 targets.
MAT_EXPR = {
    **{f"pm25_lag_{k}": _lag("pm25", k) for k in features.ROW_LAGS},
    **{f"pm25_rolling_{n}": f"{f}(pm25) {W.format(k - 1)}" for n, k, f in MAT_ROLL},
    **{f"pm25_diff_{k}": f"pm25-{_lag('pm25', k)}" for k in features.ROW_DIFFS},
    **{f"{n}_{f}": f"{f}(2*pi()*{x}/{p})" for n, x, p in (("hour", "(hour(ts)+minute(ts)/60.0E0)", 24), ("day_of_week", "(isodow(ts)-1)", 7), ("day_of_year", "dayofyear(ts)", 365),
                                                         ("week_of_year", "week(ts)", 52)) for f in ("sin", "cos")},
    **{x: x for x in ("temperature", "humidity", "pressure", "wind_speed", "traffic_index")},
    "temp_rolling_mean_3h": f"avg(temperature) {W.format(35)}", "humidity_rolling_mean_3h": f"avg(humidity) {W.format(35)}", "wind_rolling_mean_3h": f"avg(wind_speed) {W.format(35)}",
    "temp_x_humidity": "temperature*humidity/100", "traffic_rolling_mean_1h": f"avg(traffic_index) {W.format(11)}", "traffic_rolling_mean_3h": f"avg(traffic_index) {W.format(35)}",
    **{f"{p}_lag_1": _lag(p, 1) for p in ("pm10", "co", "no2", "o3")},
    "pm25_pm10_ratio": "pm25/nullif(pm10,0)", "no2_o3_ratio": "no2/nullif(o3,0)", "pm25_co_ratio": "pm25/nullif(co,0)", "pm25_no2_product": "pm25*no2", "pm25_spatial_lag": _lag("pm25", 6),
    "zone_elevation": "12.0E0", **{n: f"lead(pm25,{k}) OVER (ORDER BY ts)" for n, k in features.TARGET_ROWS.items()}}
MATRIX_SQL = f"""WITH c0 AS (SELECT date_trunc('hour', ts) AS ts, avg(value) FILTER (field='pm25') AS pm25, avg(value) FILTER (field='pm10') AS pm10, avg(value) FILTER (field='co') AS co, avg(value) FILTER (field='no2') AS no2, avg(value) FILTER (field='o3') AS o3 FROM v_readings GROUP BY 1),
w AS (SELECT date_trunc('hour', ts) AS ts, avg(temperature) AS temperature, avg(humidity) AS humidity, avg(pressure) AS pressure, avg(wind_speed) AS wind_speed FROM v_weather GROUP BY 1), tr AS (SELECT date_trunc('hour', ts) AS ts, avg(congestion_level) AS traffic_index FROM v_traffic GROUP BY 1),
c AS (SELECT ts, {', '.join(f'last_value({p} IGNORE NULLS) OVER (ORDER BY ts) AS {p}' for p in ('pm25', 'pm10', 'co', 'no2', 'o3', 'temperature', 'humidity', 'pressure', 'wind_speed', 'traffic_index'))} FROM c0 LEFT JOIN w USING (ts) LEFT JOIN tr USING (ts))
SELECT *, CAST(57 AS INTEGER) AS n_features FROM (SELECT ts, {', '.join(f'round({x}+1e-9,5) AS {n}' for n, x in MAT_EXPR.items())} FROM c) WHERE pm25_lag_288 IS NOT NULL AND target_h24 IS NOT NULL"""


@query("feat_training_matrix", MATRIX_SQL)
def _(t):
    m = features.training_matrix(cut(matrix_series(t)))
    return m.select("ts", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in MAT_EXPR], F.lit(len(m.columns) - 1 - len(features.TARGET_ROWS)).alias("n_features"))


def daily_fit(t):
    return kriging.solve(kriging.snapshots(t.v_readings, t.v_zones, every="1 day"), ["computed_at"])


#: Kernels fitted per hour. SQL has the hours, their zones and means; the fit itself is checked by what must hold for it.
@query("geo_kriging_fit", """WITH g AS (SELECT date_trunc('hour',ts) AS computed_at, zone_id, avg(value) AS v FROM v_readings JOIN v_zones USING (zone_id) WHERE field='pm25' GROUP BY 1,2)
SELECT computed_at, CAST(count(*) AS INTEGER) AS n, round(avg(v),6) AS mean, true AS solved, true AS not_below_default, true AS within_bounds FROM g GROUP BY 1 HAVING count(*)>=2""")
def _(t):
    s = cut(kriging.snapshots(t.v_readings, t.v_zones))
    fixed = kriging.solve(s, ["computed_at"]).select("computed_at", F.col("likelihood").alias("before"))
    d = kriging.solve(s, ["computed_at"], fit=True).join(fixed, "computed_at")
    lo, hi = (1 - 1e-9) * 1e-5, (1 + 1e-9) * 1e5
    return d.select("computed_at", "n", F.round("mean", 6).alias("mean"), (F.col("residual") < 1e-6).alias("solved"), (F.col("likelihood") >= F.col("before") - 1e-9).alias("not_below_default"),
                    (F.col("length").between(lo, hi) & F.col("noise").between(lo, hi)).alias("within_bounds"))


@query("geo_kriging")
def _(t):
    g = kriging.predict(daily_fit(t), ["computed_at"])
    return g.groupBy("computed_at").agg(F.count("*").alias("cells"), F.min("pm25").alias("pm25_min"), F.max("pm25").alias("pm25_max"),
                                        F.min("std").alias("std_min"), F.max("std").alias("std_max"))


@query("geo_kriging_loo")
def _(t):
    return daily_fit(t).select("computed_at", "n", "rmse_loo")


@query("geo_kriging_serve", """WITH g AS (SELECT date_trunc('hour',ts) AS computed_at, zone_id, lat_c, lon_c, avg(value) AS pm25 FROM v_readings JOIN v_zones USING (zone_id) WHERE field='pm25' GROUP BY 1,2,3,4), n AS (SELECT max(computed_at) AS m FROM g)
SELECT m AS computed_at, round(epoch($NOW-m)/3600,6) AS age_h, count(*) AS n, round(min(pm25),6) AS pm25_min, round(max(pm25),6) AS pm25_max FROM g, n WHERE computed_at=m AND lat_c BETWEEN 14.6 AND 14.8 AND lon_c BETWEEN -17.6 AND -17.3 GROUP BY 1,2""")
def _(t):
    g = kriging.snapshots(t.v_readings, t.v_zones)
    newest = g.agg(F.max("computed_at").alias("m"))
    d = g.where(F.col("computed_at") == newest.scalar()).where(in_box(F.col("lon"), F.col("lat"), -17.6, 14.6, -17.3, 14.8))
    return d.groupBy("computed_at").agg(F.count("*").alias("n"), F.round(F.min("v"), 6).alias("pm25_min"), F.round(F.max("v"), 6).alias("pm25_max")).select(
        "computed_at", F.round(tf.seconds_between(now(), F.col("computed_at")) / 3600, 6).alias("age_h"), "n", "pm25_min", "pm25_max")
