"""Supervision reports: alerts, anomalies, jobs, models, quality."""

from pyspark.sql import functions as F

from ..functions.timefeat import micros
from ..operators import quality, supervise
from ..operators.joins import nearest
from ..operators.supervise import hours, pct
from ..operators.windows import calibration_drift
from .registry import query
from .views import now


def day(df, ts):
    return df.where(F.col(ts) > now() - hours(24))


@query("agg_anomaly_distribution", "SELECT a.pollutant, coalesce(al.gravite,'unclassified') AS gravite, count(*) AS n FROM v_anomalies a LEFT JOIN v_anomaly_alerts al ON al.anomaly_id=a.id GROUP BY 1,2")
def _(t):
    al = t.v_anomaly_alerts.select(F.col("anomaly_id").alias("id"), "gravite")
    return t.v_anomalies.join(al, "id", "left").groupBy("pollutant", F.coalesce("gravite", F.lit("unclassified")).alias("gravite")).agg(F.count("*").alias("n"))


@query("agg_level_distribution", "SELECT gravite, count(*) AS n FROM v_anomaly_alerts WHERE created_at > $NOW - INTERVAL 24 HOUR GROUP BY 1")
def _(t):
    return day(t.v_anomaly_alerts, "created_at").groupBy("gravite").agg(F.count("*").alias("n"))


@query("agg_detection_rate", "SELECT date_trunc('hour', detected_at) AS hour, count(*) AS n FROM v_anomalies WHERE detected_at > $NOW - INTERVAL 24 HOUR GROUP BY 1")
def _(t):
    return day(t.v_anomalies, "detected_at").groupBy(F.date_trunc("hour", "detected_at").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


@query("agg_anomaly_heatmap", "SELECT zone_id, count(*) AS n, round(avg(anomaly_score),6) AS avg_score, max(anomaly_score) AS max_score FROM v_anomalies GROUP BY 1 ORDER BY n DESC, zone_id LIMIT 30")
def _(t):
    return t.v_anomalies.groupBy("zone_id").agg(F.count("*").alias("n"), F.round(F.avg("anomaly_score"), 6).alias("avg_score"),
                                                F.max("anomaly_score").alias("max_score")).orderBy(F.desc("n"), "zone_id").limit(30)


@query("agg_model_health", "SELECT round(avg(anomaly_score),6) AS mean_score, round(count(*) FILTER (anomaly_score>0.5E0)/CAST(nullif(count(*),0) AS DOUBLE),6) AS high_share FROM v_anomalies WHERE detected_at > $NOW - INTERVAL 24 HOUR")
def _(t):
    return day(t.v_anomalies, "detected_at").agg(
        F.round(F.avg("anomaly_score"), 6).alias("mean_score"),
        F.round(F.try_divide(F.count_if(F.col("anomaly_score") > 0.5).cast("double"), F.count("*")), 6).alias("high_share"))


@query("agg_overview", """SELECT (SELECT count(*) FROM v_sensors WHERE status='active') AS sensors_active, (SELECT count(*) FROM v_sensors) AS sensors_total, (SELECT count(*) FROM v_features) AS features,
 (SELECT count(*) FROM v_predictions) AS predictions, (SELECT count(*) FROM v_metrics) AS metrics, (SELECT count(*) FROM v_anomalies) AS anomalies, (SELECT count(*) FROM v_anomaly_alerts) AS alerts,
 (SELECT max(ts) FROM v_features) AS last_features, (SELECT max(created_at) FROM v_predictions) AS last_prediction, (SELECT max(computed_at) FROM v_metrics) AS last_metrics,
 (SELECT max(detected_at) FROM v_anomalies) AS last_anomaly, (SELECT max(training_end) FROM v_models) AS last_training""")
def _(t):
    n = F.count("*")
    return supervise.one_row([
        t.v_sensors.agg(F.count_if(F.col("status") == "active").alias("sensors_active"), n.alias("sensors_total")),
        t.v_features.agg(n.alias("features"), F.max("ts").cast("timestamp_ntz").alias("last_features")),
        t.v_predictions.agg(n.alias("predictions"), F.max("created_at").alias("last_prediction")),
        t.v_metrics.agg(n.alias("metrics"), F.max("computed_at").alias("last_metrics")),
        t.v_anomalies.agg(n.alias("anomalies"), F.max("detected_at").alias("last_anomaly")),
        t.v_anomaly_alerts.agg(n.alias("alerts")), t.v_models.agg(F.max("training_end").alias("last_training"))])


Q_SQL = """q AS (SELECT 0.75E0 AS q1, 0.95E0 AS q2, (SELECT avg(predicted_value) FROM v_predictions WHERE horizon_minutes=60) AS q3, (SELECT avg(predicted_value)/4 FROM v_predictions WHERE horizon_minutes=1440) AS q4,
 (SELECT count(*) FILTER (statut_envoi='cancelled')/CAST(count(*) AS DOUBLE) FROM v_alerts) AS q5)"""


@query("agg_quality_alerts", f"""WITH {Q_SQL}, m AS (SELECT 'data_coverage_low' AS alert_type, 'min' AS side, 0.8E0 AS lim, q1 AS v FROM q UNION ALL SELECT 'calibration_rate_low','min',0.9E0,q2 FROM q
 UNION ALL SELECT 'prediction_rmse_high_1h','max',15,q3 FROM q UNION ALL SELECT 'prediction_rmse_high_24h','max',25,q4 FROM q UNION ALL SELECT 'false_alarm_rate_high','max',0.3E0,q5 FROM q)
SELECT alert_type, 'Pipeline quality alert: '||alert_type||' = '||printf('%.3f',v)||' (seuil '||lim||')' AS message FROM m WHERE CASE WHEN side='min' THEN v<lim ELSE v>lim END AND alert_type <> 'data_coverage_low'""")
def _(t):
    p, a = t.v_predictions, t.v_alerts
    m = supervise.one_row([
        p.agg(F.lit(0.75).alias("Q1_coverage"), F.lit(0.95).alias("Q2_calibration_rate"),
              F.avg(F.when(F.col("horizon_minutes") == 60, F.col("predicted_value"))).alias("Q3_rmse_1h"),
              (F.avg(F.when(F.col("horizon_minutes") == 1440, F.col("predicted_value"))) / 4).alias("Q4_rmse_24h")),
        quality.false_alarm_rate(a).withColumnRenamed("q5_false_alarm_rate", "Q5_false_alarm_rate")])
    raised = a.agg(F.lit("data_coverage_low").alias("alert_type"))  # an alert of this type is under one hour old
    return quality.breaches(m, raised).select("alert_type", "message")


#: All five metrics computed from the tables of the last ten days (the given predictions are sparse).
REAL_SQL = """c AS (SELECT p.prediction_id, p.horizon_minutes, p.predicted_value, r.value, row_number() OVER (PARTITION BY p.prediction_id ORDER BY abs(epoch_us(r.ts)-epoch_us(p.target_timestamp)), r.ts, r.reading_id) AS rn
 FROM v_predictions p JOIN v_readings r ON r.zone_id=p.zone_id AND r.ts BETWEEN p.target_timestamp - INTERVAL 30 MINUTE AND p.target_timestamp + INTERVAL 30 MINUTE WHERE p.created_at > $NOW - INTERVAL 240 HOUR),
q AS (SELECT (SELECT round(count(*)/CAST((SELECT count(*) FILTER (status='active') FROM v_sensors)*120 AS DOUBLE),3) FROM v_readings WHERE ts >= $NOW - INTERVAL 1 HOUR) AS q1, (SELECT round(count(*) FILTER (value>2)/CAST(greatest(count(*),1) AS DOUBLE),3) FROM v_readings) AS q2,
 (SELECT sqrt(avg(pow(predicted_value-value,2))) FROM c WHERE rn=1 AND horizon_minutes=60) AS q3, (SELECT sqrt(avg(pow(predicted_value-value,2))) FROM c WHERE rn=1 AND horizon_minutes=1440) AS q4,
 (SELECT count(*) FILTER (statut_envoi='cancelled')/CAST(count(*) AS DOUBLE) FROM v_alerts) AS q5)"""


@query("agg_quality_alerts_computed", f"""WITH {REAL_SQL}, m AS (SELECT 'data_coverage_low' AS alert_type, 'min' AS side, 0.8E0 AS lim, q1 AS v FROM q UNION ALL SELECT 'calibration_rate_low','min',0.9E0,q2 FROM q
 UNION ALL SELECT 'prediction_rmse_high_1h','max',15,q3 FROM q UNION ALL SELECT 'prediction_rmse_high_24h','max',25,q4 FROM q UNION ALL SELECT 'false_alarm_rate_high','max',0.3E0,q5 FROM q)
SELECT alert_type, round(v,6) AS value, 'Pipeline quality alert: '||alert_type||' = '||printf('%.3f',v)||' (seuil '||lim||')' AS message FROM m WHERE CASE WHEN side='min' THEN v<lim ELSE v>lim END""")
def _(t):
    r = t.v_readings
    actual = nearest(t.v_predictions.where(F.col("created_at") > now() - supervise.hours(240)).select("prediction_id", "zone_id", "horizon_minutes", "predicted_value", "target_timestamp"),
                     r.withColumn("actual_value", F.col("value")), ["zone_id"], "target_timestamp", "ts", ["reading_id"], "actual_value", 1800)
    errors = quality.rmse(actual, (60, 1440)).agg(*[F.max(F.when(F.col("horizon_minutes") == h, F.col("rmse"))).alias(n) for h, n in ((60, "Q3_rmse_1h"), (1440, "Q4_rmse_24h"))])
    m = supervise.one_row([
        quality.coverage(r.where(F.col("ts") >= now() - supervise.hours(1)), t.v_sensors).withColumnRenamed("q1_coverage", "Q1_coverage"),
        quality.calibration_rate(r, r.where(F.col("value") > 2)).withColumnRenamed("q2_calibration_rate", "Q2_calibration_rate"), errors,
        quality.false_alarm_rate(t.v_alerts).withColumnRenamed("q5_false_alarm_rate", "Q5_false_alarm_rate")])
    none = t.v_alerts.where("false").select(F.lit("").alias("alert_type"))
    return quality.breaches(m, none).select("alert_type", F.round("value", 6).alias("value"), "message")


@query("agg_pipeline_health", """SELECT flow, last_run, round(epoch($NOW-last_run)/60,1) AS age_min, CASE WHEN last_run IS NULL THEN 'unknown' WHEN round(epoch($NOW-last_run)/60,1)<=warn THEN 'ok' WHEN round(epoch($NOW-last_run)/60,1)<=crit THEN 'warn' ELSE 'stale' END AS health FROM (
 SELECT 'feature_engineering' AS flow, max(ts) AS last_run, 10 AS warn, 30 AS crit FROM v_features UNION ALL SELECT 'predictions', max(created_at), 45, 90 FROM v_predictions UNION ALL SELECT 'kriging', max(computed_at), 90, 180 FROM v_metrics
 UNION ALL SELECT 'anomaly_detector', max(detected_at), 5, 15 FROM v_anomalies UNION ALL SELECT 'retraining', max(training_end), 1440, 2880 FROM v_models)""")
def _(t):
    f = t.v_features.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return supervise.flow_health({  # fixed values: warn and critical age in minutes per job
        "feature_engineering": (f, "ts", 10, 30), "predictions": (t.v_predictions, "created_at", 45, 90),
        "kriging": (t.v_metrics, "computed_at", 90, 180), "anomaly_detector": (t.v_anomalies, "detected_at", 5, 15),
        "retraining": (t.v_models, "training_end", 1440, 2880)}, now())


@query("agg_network_kpis", """WITH z AS (SELECT zone_id, avg(value) AS m FROM v_readings WHERE field='pm25' GROUP BY 1), s AS (SELECT count(*) FILTER (status='active') AS n FROM v_sensors)
SELECT round(avg(m),6) AS mean_pm25, arg_max(zone_id, m) AS worst_zone, max(s.n) AS active_sensors FROM z, s""")
def _(t):
    z = t.v_readings.where(F.col("field") == "pm25").groupBy("zone_id").agg(F.avg("value").alias("m"))
    k = z.agg(F.round(F.avg("m"), 6).alias("mean_pm25"), F.max_by("zone_id", "m").alias("worst_zone"))
    return supervise.one_row([k, t.v_sensors.agg(F.count_if(F.col("status") == "active").alias("active_sensors"))])


@query("agg_fleet_kpis", """SELECT count(*) AS total, count(*) FILTER (status='active') AS active, count(*) FILTER (status<>'active') AS inactive, round(avg(sensor_id % 101),1) AS mean_battery, round(avg(-40 - sensor_id % 60),1) AS mean_rssi,
 (SELECT count(*) FROM v_readings WHERE ts >= $NOW - INTERVAL 24 HOUR) AS messages FROM v_sensors""")
def _(t):
    s = t.v_sensors.withColumn("battery", F.col("sensor_id") % 101).withColumn("rssi", -40 - F.col("sensor_id") % 60)
    active = F.count_if(F.col("status") == "active")
    return supervise.one_row([
        s.agg(F.count("*").alias("total"), active.alias("active"), (F.count("*") - active).alias("inactive"),
              F.round(F.avg("battery"), 1).alias("mean_battery"), F.round(F.avg("rssi"), 1).alias("mean_rssi")),
        t.v_readings.where(F.col("ts") >= now() - hours(24)).agg(F.count("*").alias("messages"))])


@query("agg_anomaly_breakdown", """SELECT 'zone' AS dimension, CAST(zone_id AS VARCHAR) AS key, count(*) AS n FROM v_anomalies GROUP BY 2 UNION ALL SELECT 'pollutant', pollutant, count(*) FROM v_anomalies GROUP BY 2
UNION ALL SELECT 'hour', strftime(date_trunc('hour',detected_at),'%Y-%m-%d %H:00'), count(*) FROM v_anomalies GROUP BY 2""")
def _(t):
    a = t.v_anomalies.select(F.col("zone_id").cast("string").alias("zone"), "pollutant", F.date_format("detected_at", "yyyy-MM-dd HH:00").alias("hour"))
    dims = ["zone", "pollutant", "hour"]
    g = a.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.count("*").alias("n"))
    name = F.when(F.col("zone").isNotNull(), "zone").when(F.col("pollutant").isNotNull(), "pollutant").otherwise("hour")
    return g.select(name.alias("dimension"), F.coalesce(*dims).alias("key"), "n")


@query("agg_alert_by_gravity", "SELECT gravite, count(*) AS n, (SELECT count(*) FROM v_alerts WHERE gravite IN ('danger','critical')) AS severe_total FROM v_alerts GROUP BY 1")
def _(t):
    g = t.v_alerts.groupBy("gravite").agg(F.count("*").alias("n"))
    return supervise.attach(g, g.agg(F.sum(F.when(F.col("gravite").isin("danger", "critical"), F.col("n")).otherwise(0)).alias("severe_total")))


@query("agg_log_stats", """SELECT service, count(*) AS n, count(*) FILTER (level='ERROR') AS errors, count(*) FILTER (level='WARN') AS warnings, round(100.0E0*count(*) FILTER (level='ERROR')/greatest(count(*),1),1) AS error_pct FROM v_log GROUP BY 1 ORDER BY n DESC, service LIMIT 10""")
def _(t):
    err = F.count_if(F.col("level") == "ERROR")
    return t.v_log.groupBy("service").agg(F.count("*").alias("n"), err.alias("errors"), F.count_if(F.col("level") == "WARN").alias("warnings"),
                                          pct(err, F.count("*")).alias("error_pct")).orderBy(F.desc("n"), "service").limit(10)


DRIFT_SQL = """d AS (SELECT sensor_id, id, valid_from, round(CASE WHEN p IS NULL OR p=0 THEN 0 ELSE abs(m-p)/abs(p)*100 END,3) AS drift_pct FROM (
 SELECT *, lag(m) OVER (PARTITION BY sensor_id ORDER BY valid_from, id) AS p FROM (SELECT *, (coef_a+coef_b)/2 AS m FROM v_calibration)))"""


@query("agg_drift_histogram", f"""WITH {DRIFT_SQL} SELECT CASE WHEN drift_pct<=1 THEN '0-1' WHEN drift_pct<=2 THEN '1-2' WHEN drift_pct<=3 THEN '2-3' WHEN drift_pct<=5 THEN '3-5' WHEN drift_pct<=10 THEN '5-10' ELSE '10+' END AS bucket, count(*) AS n FROM d WHERE drift_pct>0 GROUP BY 1""")
def _(t):
    d = F.col("drift_pct")
    b = F.when(d <= 1, "0-1").when(d <= 2, "1-2").when(d <= 3, "2-3").when(d <= 5, "3-5").when(d <= 10, "5-10").otherwise("10+")
    return calibration_drift(t.v_calibration).where(d > 0).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("agg_best_r2", "SELECT sensor_id, round(greatest(max(r2_score),0),6) AS best_r2, arg_max(id, (valid_from,id)) AS latest_id FROM v_calibration GROUP BY 1")
def _(t):
    return t.v_calibration.groupBy("sensor_id").agg(F.round(F.greatest(F.max("r2_score"), F.lit(0.0)), 6).alias("best_r2"),
                                                    F.max_by("id", F.struct("valid_from", "id")).alias("latest_id"))


@query("agg_r2_compare", "SELECT valid_from, round(max(r2_score) FILTER (sensor_id=3),6) AS s3, round(max(r2_score) FILTER (sensor_id=7),6) AS s7 FROM v_calibration WHERE sensor_id IN (3,7) GROUP BY 1 ORDER BY 1 LIMIT 50")
def _(t):
    c = t.v_calibration.where(F.col("sensor_id").isin(3, 7))
    return c.groupBy("valid_from").pivot("sensor_id", [3, 7]).agg(F.max("r2_score")).select(
        "valid_from", F.round("3", 6).alias("s3"), F.round("7", 6).alias("s7")).orderBy("valid_from").limit(50)


@query("agg_reports_per_day", """WITH c AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n, count(*) FILTER (report_id IN (SELECT report_id FROM v_entities)) AS e FROM v_reports GROUP BY 1)
SELECT CAST(g AS DATE) AS day, coalesce(n,0) AS n, round(coalesce(e/CAST(n AS DOUBLE),0),6) AS with_entities FROM generate_series(DATE '2024-01-25', DATE '2024-01-31', INTERVAL 1 DAY) s(g) LEFT JOIN c ON c.day=CAST(g AS DATE)""")
def _(t):
    e = t.v_entities.select("report_id").distinct().withColumn("hit", F.lit(1))
    c = t.v_reports.select("report_id", F.to_date("created_at").alias("day")).join(e, "report_id", "left").groupBy("day").agg(
        F.count("*").alias("n"), F.count("hit").alias("e"))
    last = F.to_date(now())
    spine = t.spark.range(1).select(F.explode(F.sequence(F.date_sub(last, 6), last)).alias("day"))
    return spine.join(c, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce(F.col("e") / F.col("n"), F.lit(0.0)), 6).alias("with_entities"))
