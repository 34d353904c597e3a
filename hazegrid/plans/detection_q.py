"""Anomaly detection."""

from pyspark.sql import functions as F

from ..functions.aqi import POLLUTANTS
from ..operators import detect, forest
from ..session import cut
from .registry import query
from .views import now

CELLS = ["pm25", "pm10", "co", "no2", "o3", "temperature", "humidity", "pressure"]


def wide(t):
    """Hourly wide rows per zone with the eight features of the forest; missing ones are 0."""
    h = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    a = t.v_readings.groupBy("zone_id", h).agg(*[F.avg(F.when(F.col("field") == p, F.col("value"))).alias(p) for p in POLLUTANTS])
    w = t.v_weather.groupBy("zone_id", h).agg(*[F.avg(c).alias(c) for c in ("temperature", "humidity", "pressure")])
    return cut(a.join(w, ["zone_id", "ts"], "left").fillna(0.0, CELLS).withColumn("row_id", F.xxhash64("zone_id", "ts")))


def forest_findings(t):
    rows = wide(t)
    model = forest.fit(rows, CELLS, "row_id")
    if model is None:
        return rows.select("zone_id", "ts", F.lit(0.0).alias("score"), "pm25").where(F.lit(False))
    enough = rows.groupBy("zone_id").agg(F.count("*").alias("n"), F.max_by(F.struct("ts", *CELLS), "ts").alias("r")).where(
        F.col("n") >= detect.MIN_POINTS)
    return model.score(enough.select("zone_id", "r.*"), "score").select("zone_id", "ts", "score", "pm25")


THR_SQL = """thr(field, w, d) AS (VALUES ('pm25',50.1E0,100.1E0),('pm10',155E0,255E0),('co',9.5E0,12.5E0),('no2',101E0,361E0),('o3',71E0,86E0)),
l AS (SELECT sensor_id, field, arg_max(value,(ts,reading_id)) AS value FROM v_readings GROUP BY 1,2)"""


@query("det_threshold", f"WITH {THR_SQL} SELECT sensor_id, field AS pollutant, CASE WHEN value>=d THEN 'danger' ELSE 'warning' END AS severity, round(value,6) AS detected_value, CASE WHEN value>=d THEN d ELSE w END AS threshold FROM l JOIN thr USING (field) WHERE value>=w")
def _(t):
    last = detect.latest(t.v_readings, ["sensor_id", "field"])
    return detect.threshold_findings(last).select("sensor_id", "pollutant", "severity", F.round("detected_value", 6).alias("detected_value"), "threshold")


@query("det_stuck_sensor", """SELECT sensor_id, round(avg(value),6) AS detected_value FROM (SELECT * , CASE WHEN sensor_id % 4 = 1 THEN 20+value/10000 ELSE value END AS v FROM v_readings) WHERE field='pm25' GROUP BY sensor_id HAVING count(*)>=10 AND stddev_samp(v)<0.1E0""")
def _(t):
    r = t.v_readings  # every fourth sensor is made to hang at one value
    hung = r.withColumn("value", F.when(F.col("sensor_id") % 4 == 1, 20 + F.col("value") / 10000).otherwise(F.col("value")))
    mean = r.where(F.col("field") == "pm25").groupBy("sensor_id").agg(F.round(F.avg("value"), 6).alias("detected_value"))
    return detect.stuck(hung).select("sensor_id").join(mean, "sensor_id")


@query("det_implausible_ratio", """WITH d AS (SELECT sensor_id, date_trunc('day',ts) AS day, count(*) AS n, avg(value) FILTER (field='pm25') AS a, avg(value) FILTER (field='pm10') AS b FROM v_readings WHERE ts > $NOW - INTERVAL 480 HOUR AND ts <= $NOW GROUP BY 1,2),
l AS (SELECT sensor_id, sum(n) AS n, arg_max(a, day) FILTER (a IS NOT NULL AND b IS NOT NULL) AS a, arg_max(b, day) FILTER (a IS NOT NULL AND b IS NOT NULL) AS b FROM d GROUP BY 1)
SELECT sensor_id, round(a,6) AS detected_value, round(b*1.5E0,6) AS threshold FROM l WHERE n>=10 AND b>0 AND a>b*1.5E0""")
def _(t):
    r = detect.look_back(t.v_readings, now(), 480)  # sparse events: days stand in for the sensors' rows
    daily = r.withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return detect.implausible_ratio(daily).select("sensor_id", F.round("detected_value", 6).alias("detected_value"),
                                                  F.round("threshold", 6).alias("threshold"))


@query("det_isolation_forest")
def _(t):
    s = forest_findings(t)
    return s.select("zone_id", "ts", "score", (F.col("score") < 0).alias("flagged"), detect.severity(F.col("score")).alias("severity"))


@query("ml_isolation_forest_fit")
def _(t):
    rows = wide(t)
    model = forest.fit(rows, CELLS, "row_id")
    if model is None:
        return rows.agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("mean_decision"), F.lit(None).cast("double").alias("flagged_pct"))
    return model.score(rows).agg(F.count("*").alias("n"), F.avg("decision").alias("mean_decision"),
                                 (F.avg(F.when(F.col("decision") < 0, 1.0).otherwise(0.0)) * 100).alias("flagged_pct"))


@query("det_findings")
def _(t):
    r = t.v_readings
    level2 = forest_findings(t).where(F.col("score") < 0).select(
        F.lit(None).cast("long").alias("sensor_id"), "zone_id", "ts", F.lit("pollution_anomaly").alias("type"), F.lit("pm25").alias("pollutant"),
        detect.severity(F.col("score")).alias("severity"), F.col("pm25").alias("detected_value"), F.lit(0.0).alias("threshold"), "score")
    window = detect.look_back(r, now(), 480)
    newest = detect.latest(window, ["sensor_id", "field"])
    found = cut(detect.findings(detect.threshold_findings(newest), level2, detect.stuck(window), detect.implausible_ratio(window)))
    a = detect.alerts(found)
    return a.select("zone_id", "alert_at", "type", "pollutant", "severity", F.round("detected_value", 6).alias("detected_value"))


#: Structural rules over the last two hours of sensor rows, as the job runs them.
STRUCT_SQL = """w AS (SELECT * FROM v_dense WHERE ts > $NOW - INTERVAL 2 HOUR AND ts <= $NOW),
k AS (SELECT sensor_id, zone_id, max(ts) AS ts, 'stuck_sensor' AS type, avg(value) AS detected_value, 0.1E0 AS threshold FROM w WHERE field='pm25' GROUP BY 1,2 HAVING count(*)>=10 AND stddev_samp(value)<0.1E0),
r AS (SELECT sensor_id, zone_id, ts, count(*) AS n, avg(value) FILTER (field='pm25') AS a, avg(value) FILTER (field='pm10') AS b FROM w GROUP BY 1,2,3),
l AS (SELECT sensor_id, zone_id, sum(n) AS n, max(ts) AS ts, arg_max(a,ts) AS a, arg_max(b,ts) AS b FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1,2),
i AS (SELECT sensor_id, zone_id, ts, 'implausible_ratio' AS type, a AS detected_value, b*1.5E0 AS threshold FROM l WHERE n>=10 AND b>0 AND a>b*1.5E0)"""


@query("det_structural_2h", f"WITH {STRUCT_SQL} SELECT sensor_id, zone_id, ts, type, round(detected_value,6) AS detected_value, round(threshold,6) AS threshold FROM (SELECT * FROM k UNION ALL SELECT * FROM i)")
def _(t):
    w = detect.look_back(t.v_dense, now())
    f = detect.findings(detect.stuck(w), detect.implausible_ratio(w))
    return f.select("sensor_id", "zone_id", "ts", "type", F.round("detected_value", 6).alias("detected_value"), F.round("threshold", 6).alias("threshold"))


#: Threshold and structural findings of the last two hours as alerts: one per zone and half hour, carrying the gravest finding of its time.
@query("det_alerts_2h", f"""WITH RECURSIVE {STRUCT_SQL}, thr(field, lo, hi) AS (VALUES ('pm25',50.1E0,100.1E0),('pm10',155E0,255E0)),
nw AS (SELECT sensor_id, field, zone_id, max(ts) AS ts, arg_max(value,(ts,reading_id)) AS value FROM w GROUP BY 1,2,3),
h AS (SELECT sensor_id, zone_id, ts, 'threshold_exceeded' AS type, field AS pollutant, CASE WHEN value>=hi THEN 'danger' ELSE 'warning' END AS severity, value AS v FROM nw JOIN thr USING (field) WHERE value>=lo),
f AS (SELECT * FROM h UNION ALL SELECT sensor_id, zone_id, ts, type, 'pm25', 'warning', detected_value FROM k UNION ALL SELECT sensor_id, zone_id, ts, type, 'pm25', 'warning', detected_value FROM i),
a AS (SELECT DISTINCT zone_id, ts AS t FROM f), nx AS MATERIALIZED (SELECT x.zone_id, x.t, min(b.t) AS nxt FROM a x JOIN a b ON x.zone_id=b.zone_id AND b.t >= x.t + INTERVAL 30 MINUTE GROUP BY 1,2),
s AS (SELECT zone_id, min(t) AS t FROM a GROUP BY 1 UNION ALL SELECT s.zone_id, nx.nxt FROM s JOIN nx ON nx.zone_id=s.zone_id AND nx.t=s.t)
SELECT zone_id, alert_at, type, pollutant, severity, round(v,6) AS detected_value FROM (SELECT s.zone_id, s.t AS alert_at, f.*EXCLUDE (zone_id, ts), row_number() OVER (PARTITION BY s.zone_id, s.t ORDER BY severity<>'danger', type, pollutant, sensor_id) AS rn FROM s JOIN f ON f.zone_id=s.zone_id AND f.ts=s.t) WHERE rn=1""")
def _(t):
    w = detect.look_back(t.v_dense, now())
    found = cut(detect.findings(detect.threshold_findings(detect.latest(w, ["sensor_id", "field", "zone_id"])), detect.stuck(w), detect.implausible_ratio(w)))
    return detect.alerts(found).select("zone_id", "alert_at", "type", "pollutant", "severity", F.round("detected_value", 6).alias("detected_value"))
