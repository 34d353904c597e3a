"""Window functions and ordered folds."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timefeat import trend
from ..operators import detect, features, folds, models, scan, windows
from .registry import query
from .supervision_q import DRIFT_SQL
from .views import now

CITY_SQL = """c0 AS (SELECT date_trunc('hour', ts) AS ts, avg(value) FILTER (field='pm25') AS pm25, avg(value) FILTER (field='pm10') AS pm10, avg(value) FILTER (field='co') AS co, avg(value) FILTER (field='no2') AS no2,
 avg(value) FILTER (field='o3') AS o3 FROM v_readings GROUP BY 1), city AS (SELECT ts, """ + ", ".join(
    f"last_value({p} IGNORE NULLS) OVER (ORDER BY ts) AS {p}" for p in ("pm25", "pm10", "co", "no2", "o3")) + " FROM c0)"


def city(t):
    """Hourly series over all zones, gaps filled with the last value (the stand-in data are sparse)."""
    s = windows.city_series(t.v_readings, "1 hour", ("pm25", "pm10", "co", "no2", "o3"))
    return fill(s, ("pm25", "pm10", "co", "no2", "o3"))


def fill(s, cols):
    d = scan.running(s, [], "ts", ["ts"], {f"_{c}": ("last", F.col(c)) for c in cols}, chunk_s=30 * 24 * 3600)
    return d.select("ts", *[c for c in s.columns if c not in cols and c != "ts"], *[F.col(f"_{c}").alias(c) for c in cols])


def over_rows(t, build, before=0, after=0):
    return scan.row_windows(city(t), [], "ts", ["ts"], build, before=before, after=after)


def r6(cols):
    return [F.round(c, 6).alias(c) for c in cols]


@query("win_latest_per_key", """SELECT zone_id, horizon_minutes, prediction_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY zone_id, horizon_minutes ORDER BY created_at DESC, prediction_id DESC) AS rn FROM v_predictions) WHERE rn=1""")
def _(t):
    return detect.latest(t.v_predictions, ["zone_id", "horizon_minutes"], "created_at", "prediction_id").select(
        "zone_id", "horizon_minutes", "prediction_id", "created_at")


@query("win_lag_steps", f"WITH {CITY_SQL} SELECT ts, " + ", ".join(f"round(lag(pm25,{k}) OVER (ORDER BY ts),6) AS pm25_lag_{k}" for k in features.ROW_LAGS) + " FROM city")
def _(t):
    d = over_rows(t, lambda w: features.lag_columns(F.col("pm25"), w, features.ROW_LAGS, "pm25_lag"), before=288)
    return d.select("ts", *r6([f"pm25_lag_{k}" for k in features.ROW_LAGS]))


@query("win_lead_targets", f"WITH {CITY_SQL} SELECT * FROM (SELECT ts, round(lead(pm25,12) OVER (ORDER BY ts),6) AS target_h1, round(lead(pm25,72) OVER (ORDER BY ts),6) AS target_h6, round(lead(pm25,288) OVER (ORDER BY ts),6) AS target_h24 FROM city) WHERE target_h24 IS NOT NULL")
def _(t):
    d = over_rows(t, lambda w: {n: F.lead("pm25", k).over(w) for n, k in features.TARGET_ROWS.items()}, after=288)
    return d.select("ts", *r6(features.TARGET_ROWS)).dropna()


ROWS = (12, 36, 72, 144, 288)
STATS = {"mean": ("avg", F.avg), "std": ("stddev_samp", F.stddev_samp), "min": ("min", F.min), "max": ("max", F.max),
         "median": ("median", lambda x: F.percentile(x, 0.5))}


@query("win_rolling_rows", f"WITH {CITY_SQL} SELECT ts, " + ", ".join(
    f"round(CASE WHEN count(pm25) OVER (ORDER BY ts ROWS BETWEEN {n-1} PRECEDING AND CURRENT ROW)={n} THEN {s}(pm25) OVER (ORDER BY ts ROWS BETWEEN {n-1} PRECEDING AND CURRENT ROW) END+1e-9,6) AS {k}_{n}"
    for n in ROWS for k, (s, _) in STATS.items()) + " FROM city")
def _(t):
    names = [f"{k}_{n}" for n in ROWS for k in STATS]
    d = over_rows(t, lambda w: {f"{k}_{n}": windows.full(w, n, f(F.col("pm25")), F.col("pm25"))
                                for n in ROWS for k, (_, f) in STATS.items()}, before=288)
    return d.select("ts", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in names])  # 1e-9: halves round the same way in SQL


@query("win_diff", f"WITH {CITY_SQL} SELECT ts, " + ", ".join(f"round(pm25-lag(pm25,{k}) OVER (ORDER BY ts),6) AS diff_{k}" for k in (1, 3, 12, 24)) + " FROM city")
def _(t):
    d = over_rows(t, lambda w: {f"diff_{k}": F.col("pm25") - F.lag("pm25", k).over(w) for k in features.ROW_DIFFS}, before=24)
    return d.select("ts", *r6([f"diff_{k}" for k in features.ROW_DIFFS]))


ANCHOR_SQL = "a AS (SELECT zone_id, t FROM (SELECT DISTINCT zone_id FROM v_zones), generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR) g(t))"


def anchors(t):
    """Every zone at every full hour of the data's month."""
    hours = F.sequence(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), now(), F.expr("INTERVAL '1' HOUR"))
    return t.v_zones.select("zone_id", F.explode(hours).alias("t"))


def _rw(expr, h, f="pm25"):
    return f"{expr} FILTER (r.field='{f}' AND r.ts >= a.t - INTERVAL {h} HOUR)+1e-9"


ROLL_SQL = ", ".join(
    [f"round({_rw('avg(value)', k)},4) AS pm25_rolling_mean_{features.label(k)}" for k in features.MEAN_HOURS]
    + [f"round({_rw('stddev_samp(value)', k)},4) AS pm25_rolling_std_{k}h" for k in features.STD_HOURS]
    + [f"round({_rw(f'{s}(value)', k)},4) AS pm25_rolling_{s}_{k}h" for k in features.MIN_MAX_HOURS for s in ("min", "max")]
    + [f"round({_rw('median(value)', 6)},4) AS pm25_rolling_median_6h", f"round({_rw('quantile_cont(value,0.95)', 24)},4) AS pm25_rolling_p95_24h"]
    + [f"round({_rw('avg(value)', k, 'pm10')},4) AS pm10_rolling_mean_{k}h" for k in features.PM10_MEAN_HOURS])


@query("win_rolling_time", f"WITH {ANCHOR_SQL} SELECT a.zone_id, a.t, {ROLL_SQL} FROM a LEFT JOIN v_readings r ON r.zone_id=a.zone_id AND r.ts >= a.t - INTERVAL 168 HOUR AND r.ts < a.t GROUP BY 1,2")
def _(t):
    r = features.rolling(t.v_readings, anchors(t))
    return r.select("zone_id", "t", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in r.columns if c not in ("zone_id", "t")])


LAG_SQL = ", ".join(f"round(first({f}) OVER (PARTITION BY zone_id ORDER BY hour RANGE BETWEEN INTERVAL {k} HOUR PRECEDING AND INTERVAL {k} HOUR PRECEDING),6) AS {f}_lag_{k}h"
                    for f, ks in features.HOUR_LAGS.items() for k in ks)
HOUR_SQL = "h AS (SELECT zone_id, date_trunc('hour',ts) AS hour, " + ", ".join(
    f"avg(value) FILTER (field='{p}') AS {p}" for p in ("pm25", "pm10", "co", "no2", "o3")) + " FROM v_readings GROUP BY 1,2)"


@query("win_hour_lags", f"WITH {HOUR_SQL} SELECT zone_id, hour, {LAG_SQL} FROM h")
def _(t):
    h = windows.hourly(t.v_readings, ("pm25", "pm10", "co", "no2", "o3"))
    d = windows.hour_lags(h, features.HOUR_LAGS)
    return d.select("zone_id", "hour", *r6([f"{f}_lag_{k}h" for f, ks in features.HOUR_LAGS.items() for k in ks]))


def _lg(k):
    return f"first(pm25) OVER (PARTITION BY zone_id ORDER BY hour RANGE BETWEEN INTERVAL {k} HOUR PRECEDING AND INTERVAL {k} HOUR PRECEDING)"


@query("win_derivatives", f"""WITH {HOUR_SQL}, l AS (SELECT zone_id, hour, pm25, {', '.join(f'{_lg(k)} AS l{k}' for k in (1, 3, 6, 12, 24))} FROM h)
SELECT zone_id, hour, round(pm25-l1,6) AS pm25_delta_1h, round(pm25-l3,6) AS pm25_delta_3h, round(pm25-l6,6) AS pm25_delta_6h, round(pm25-l12,6) AS pm25_delta_12h, round((pm25-l1)-(l1-l6),6) AS pm25_accel_1h,
 round(CASE WHEN l24>0 THEN (pm25-l24)/l24*100 END,6) AS pm25_daily_change_pct FROM l""")
def _(t):
    d = windows.hour_lags(windows.hourly(t.v_readings, ("pm25", "pm10", "co", "no2", "o3")), {"pm25": (1, 3, 6, 12, 24)})
    c = features.derivatives(F.col("pm25"), {k: F.col(f"pm25_lag_{k}h") for k in (1, 3, 6, 12, 24)})
    return d.select("zone_id", "hour", *[F.round(x, 6).alias(n) for n, x in c.items()])


@query("win_trend", f"""WITH {HOUR_SQL}, l AS (SELECT zone_id, hour, pm25, lag(pm25) OVER (PARTITION BY zone_id ORDER BY hour) AS p FROM h)
SELECT zone_id, hour, CASE WHEN pm25 IS NULL OR p IS NULL THEN NULL WHEN pm25 > p*1.1E0 THEN 'increasing' WHEN pm25 < p*0.9E0 THEN 'decreasing' ELSE 'stable' END AS trend FROM l""")
def _(t):
    h = windows.hourly(t.v_readings, ("pm25", "pm10", "co", "no2", "o3"))
    w = W.partitionBy("zone_id").orderBy("hour")  # one row per zone and hour
    return h.select("zone_id", "hour", trend(F.col("pm25"), F.lag("pm25").over(w)).alias("trend"))


@query("win_calibration_drift", f"WITH {DRIFT_SQL} SELECT sensor_id, id, drift_pct FROM d")
def _(t):
    return windows.calibration_drift(t.v_calibration).select("sensor_id", "id", "drift_pct")


@query("win_seq_dedup", """SELECT reading_id, sensor_id, seq FROM (SELECT *, max(seq) OVER (PARTITION BY sensor_id ORDER BY ts, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM v_readings) WHERE m IS NULL OR seq > m""")
def _(t):
    return windows.seq_dedup(t.v_readings, "sensor_id", "seq", "ts", "reading_id").select("reading_id", "sensor_id", "seq")


@query("win_seq_gaps", """SELECT sensor_id, ts, p+1 AS gap_start, seq-1 AS gap_end, seq-p-1 AS size FROM (SELECT *, lag(seq) OVER (PARTITION BY sensor_id ORDER BY ts, reading_id) AS p FROM v_readings) WHERE seq-p > 1""")
def _(t):
    return windows.seq_gaps(t.v_readings, "sensor_id", "seq", "ts", "reading_id")


@query("win_sequences", f"""WITH {CITY_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM city WHERE pm25 IS NOT NULL AND pm10 IS NOT NULL)
SELECT b.rn, CAST(count(*) AS INTEGER) AS steps, round(sum(a.pm25),6) AS sum_pm25, round(arg_min(a.pm10,a.rn),6) AS first_pm10, round(max(b.pm25),6) AS target FROM n b JOIN n a ON a.rn BETWEEN b.rn-48 AND b.rn-1 WHERE b.rn>48 AND (b.rn-1-48)%6=0 GROUP BY 1""")
def _(t):
    d = windows.sequences(city(t).select("ts", "pm25", "pm10").dropna(), [], "ts", ["pm25", "pm10"], "pm25", 48, 6)
    return d.select("rn", F.size("sequence").alias("steps"),
                    F.round(F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0]), 6).alias("sum_pm25"),
                    F.round(F.col("sequence")[0][1], 6).alias("first_pm10"), F.round("pm25", 6).alias("target"))


@query("win_time_split", """SELECT reading_id, row_number() OVER (ORDER BY ts, reading_id) <= floor(0.85E0*count(*) OVER ()) AS is_train FROM v_readings""")
def _(t):
    return models.time_split(t.v_readings, "ts", ["ts", "reading_id"]).select("reading_id", "is_train")


@query("win_model_history", """SELECT name, id, rmse, prev, coalesce((prev-rmse)/greatest(prev,1e-6) >= 0.005E0, true) AS keep FROM (SELECT *, lag(rmse) OVER (PARTITION BY name ORDER BY training_end, id) AS prev FROM v_models WHERE training_end IS NOT NULL)""")
def _(t):
    m = windows.previous(t.v_models.where(F.col("training_end").isNotNull()), ["name"], "training_end", "id", F.col("rmse"), "prev",
                         chunk_s=24 * 3600)
    keep = (F.col("prev") - F.col("rmse")) / F.greatest(F.col("prev"), F.lit(1e-6)) >= 0.005
    return m.select("name", "id", "rmse", "prev", F.coalesce(keep, F.lit(True)).alias("keep"))


@query("win_next_run", "SELECT type, max(training_end) + INTERVAL 24 HOUR AS next_run FROM v_models GROUP BY 1")
def _(t):
    return t.v_models.groupBy("type").agg((F.max("training_end") + F.expr("INTERVAL '24' HOUR")).alias("next_run"))


COOL_SQL = """a AS (SELECT DISTINCT zone_id, detected_at AS t FROM v_anomalies), n AS MATERIALIZED (SELECT x.zone_id, x.t, min(b.t) AS nxt FROM a x JOIN a b ON x.zone_id=b.zone_id AND b.t >= x.t + INTERVAL 30 MINUTE GROUP BY 1,2),
r AS (SELECT zone_id, min(t) AS t FROM a GROUP BY 1 UNION ALL SELECT r.zone_id, n.nxt FROM r JOIN n ON n.zone_id=r.zone_id AND n.t=r.t)"""


@query("win_alert_cooldown", f"WITH RECURSIVE {COOL_SQL} SELECT zone_id, t AS detected_at FROM r")
def _(t):
    return folds.cooldown(t.v_anomalies, ["zone_id"], "detected_at", 1800)


KALMAN_SQL = """z AS (SELECT reading_id, sensor_id, ts, value, row_number() OVER (PARTITION BY sensor_id ORDER BY ts, reading_id) AS rn FROM v_readings WHERE field='pm25'),
k AS (SELECT sensor_id, reading_id, rn, (4.0E0+0.5E0)/(4.0E0+0.5E0+4.0E0) AS g, value AS x, (1-(4.0E0+0.5E0)/(4.0E0+0.5E0+4.0E0))*(4.0E0+0.5E0) AS p FROM z WHERE rn=1 UNION ALL
 SELECT z.sensor_id, z.reading_id, z.rn, (k.p+0.5E0)/(k.p+4.5E0), k.x+(k.p+0.5E0)/(k.p+4.5E0)*(z.value-k.x), (1-(k.p+0.5E0)/(k.p+4.5E0))*(k.p+0.5E0) FROM k JOIN z ON z.sensor_id=k.sensor_id AND z.rn=k.rn+1)"""


@query("st_kalman", f"WITH RECURSIVE {KALMAN_SQL} SELECT reading_id, sensor_id, round(x,6) AS x, round(g,6) AS gain, round(sqrt(p),6) AS std FROM k")
def _(t):
    k = folds.kalman(t.v_readings.where(F.col("field") == "pm25"), ["sensor_id"], "ts", "reading_id", "value")
    return k.select("reading_id", "sensor_id", *r6(["x", "gain", "std"]))
