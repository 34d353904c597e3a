"""Time-window and grouped aggregates over measurements, calibrations, predictions and reports."""

from pyspark.sql import functions as F

from ..functions import aqi, text
from ..functions.aqi import POLLUTANTS
from ..operators import kriging, models, rollup, sketches
from ..operators.supervise import attach, hours, one_row, pct
from ..operators.windows import hourly
from ..session import shared_dir
from .registry import query
from .views import now

NTZ = "timestamp_ntz"


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def recent(df, ts, h):
    return df.where(F.col(ts) >= now() - hours(h))


ROLL = """round(avg(value),6) AS mean, round(min(value),6) AS min, round(max(value),6) AS max, round(stddev_samp(value),6) AS stddev,
 round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.95),6) AS p95, count(DISTINCT sensor_id) AS sensor_count FROM v_readings GROUP BY 1,2,3,4"""


def _roll(t, every):
    return rollup.rollup(t.v_readings, every).select("zone_id", "pollutant", "window_start", "window_end",
                                                     *r6("mean", "min", "max", "stddev", "p50", "p95"), "sensor_count")


@query("agg_hourly_rollup", f"SELECT zone_id, field AS pollutant, date_trunc('hour',ts) AS window_start, date_trunc('hour',ts)+INTERVAL 1 HOUR AS window_end, {ROLL}")
def _(t):
    return _roll(t, "1 hour")


@query("agg_daily_rollup", f"SELECT zone_id, field AS pollutant, CAST(date_trunc('day',ts) AS TIMESTAMP) AS window_start, CAST(date_trunc('day',ts)+INTERVAL 1 DAY AS TIMESTAMP) AS window_end, {ROLL}")
def _(t):
    return _roll(t, "1 day")


#: Spans joined from stored hours. Percentiles are exact order statistics while a span holds fewer values than its sketch keeps.
SPAN_SQL = """SELECT zone_id, field AS pollutant, '{span}' AS span, CAST(date_trunc('{span}', ts) AS TIMESTAMP) AS window_start, count(*) AS n, round(avg(value),6) AS mean, round(min(value),6) AS min, round(max(value),6) AS max,
 round(stddev_samp(value),6) AS stddev, count(DISTINCT sensor_id) BETWEEN 0.98E0*count(DISTINCT sensor_id) AND 1.02E0*count(DISTINCT sensor_id) AS sensors_within, CASE WHEN count(*) <= 100 THEN round(quantile_disc(value,0.5),6) END AS p50, CASE WHEN count(*) <= 100 THEN round(quantile_disc(value,0.95),6) END AS p95,
 true AS p50_within, true AS p95_within FROM v_readings GROUP BY 1,2,4"""


@query("agg_rollup_from_sketches", " UNION ALL ".join(SPAN_SQL.format(span=s) for s in ("day", "month")))
def _(t):
    path = shared_dir(t.spark, "hour-sketches")
    sketches.hour_sketches(t.v_readings).write.parquet(path)
    hours_ = t.spark.read.parquet(path)
    out, keys = None, ["zone_id", "field"]
    for span in ("day", "month"):
        at = lambda c: F.date_trunc(span, c).cast(NTZ)  # noqa: B023,E731
        d = sketches.joined(hours_, keys, at("window_start"), "w").select(*keys, "w", *sketches.columns())
        d = sketches.rank_checked(d, t.v_readings, keys, at("ts"), (0.5, 0.95), 2 * sketches.rank_error(), "w")
        true = t.v_readings.groupBy(*keys, at("ts").alias("w")).agg(F.count_distinct("sensor_id").alias("_s"))
        d = d.join(true, [*keys, "w"]).withColumn("sensors_within", F.abs(F.col("sensor_count") - F.col("_s")) <= 0.02 * F.col("_s"))
        few = F.col("n") <= 100
        d = d.select("zone_id", F.col("field").alias("pollutant"), F.lit(span).alias("span"), F.col("w").alias("window_start"), "n", *r6("mean", "min", "max", "stddev"), "sensors_within",
                     *[F.when(few, F.round(c, 6)).alias(c) for c in ("p50", "p95")], "p50_within", "p95_within")
        out = d if out is None else out.unionByName(d)
    return out


@query("agg_exceedance_hours", """SELECT zone_id, CAST(hour AS DATE) AS day, CAST(sum(CASE WHEN m>15 THEN 1 ELSE 0 END) AS BIGINT) AS exceedance_hours
FROM (SELECT zone_id, date_trunc('hour',ts) AS hour, avg(value) AS m FROM v_readings WHERE field='pm25' GROUP BY 1,2) GROUP BY 1,2""")
def _(t):
    return rollup.exceedance_hours(t.v_readings)


@query("agg_distinct_sensors", "SELECT zone_id, date_trunc('hour',ts) AS hour, count(DISTINCT sensor_id) AS sensors FROM v_readings WHERE field='pm25' GROUP BY 1,2")
def _(t):
    return t.v_readings.where(F.col("field") == "pm25").groupBy("zone_id", F.date_trunc("hour", "ts").cast(NTZ).alias("hour")).agg(
        F.count_distinct("sensor_id").alias("sensors"))


@query("agg_zone_recent", "SELECT zone_id, field, round(avg(value),6) AS mean FROM v_readings WHERE ts >= $NOW - INTERVAL 6 HOUR GROUP BY 1,2")
def _(t):
    return recent(t.v_readings, "ts", 6).groupBy("zone_id", "field").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("agg_zone_history", """SELECT zone_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS window_start, round(avg(value) FILTER (field='pm25'),6) AS pm25, round(avg(value) FILTER (field='pm10'),6) AS pm10,
 CAST(CASE WHEN avg(value) FILTER (field='pm25') IS NULL THEN NULL WHEN avg(value) FILTER (field='pm25')<=25 THEN round_even(avg(value) FILTER (field='pm25')/25*50,0) WHEN avg(value) FILTER (field='pm25')<=55 THEN round_even(51+(avg(value) FILTER (field='pm25')-25)/30*49,0)
 WHEN avg(value) FILTER (field='pm25')<=150 THEN round_even(101+(avg(value) FILTER (field='pm25')-55)/95*49,0) WHEN avg(value) FILTER (field='pm25')<=250 THEN round_even(151+(avg(value) FILTER (field='pm25')-150)/100*49,0)
 WHEN avg(value) FILTER (field='pm25')<=350 THEN round_even(201+(avg(value) FILTER (field='pm25')-250)/100*99,0) ELSE round_even(301+(avg(value) FILTER (field='pm25')-350)/150*199,0) END AS INTEGER) AS aqi FROM v_readings GROUP BY 1,2""")
def _(t):
    h = rollup.series(t.v_readings, "6 hours", ["zone_id"], ["pm25", "pm10"])
    return h.select("zone_id", "window_start", *r6("pm25", "pm10"), aqi.local_pm25_index(F.col("pm25")).alias("aqi"))


@query("agg_sensor_series", "SELECT sensor_id, field, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, round(avg(value),6) AS mean FROM v_readings WHERE ts >= $NOW - INTERVAL 72 HOUR GROUP BY 1,2,3")
def _(t):
    return rollup.series(recent(t.v_readings, "ts", 72), "5 minutes", ["sensor_id", "field"]).select(
        "sensor_id", "field", "window_start", *r6("mean"))


@query("agg_series_15m", "SELECT zone_id, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, round(avg(value),6) AS mean FROM v_readings WHERE field='pm25' AND ts >= $NOW - INTERVAL 24 HOUR GROUP BY 1,2")
def _(t):
    return rollup.series(recent(t.v_readings, "ts", 24).where(F.col("field") == "pm25"), "15 minutes", ["zone_id"]).select(
        "zone_id", "window_start", *r6("mean"))


@query("agg_monthly", """SELECT zone_id, field, CAST(date_trunc('month',day) AS DATE) AS month, round(avg(m),6) AS mean FROM (SELECT zone_id, field, CAST(ts AS DATE) AS day, avg(value) AS m FROM v_readings WHERE ts >= $NOW - INTERVAL 365 DAY GROUP BY 1,2,3) GROUP BY 1,2,3""")
def _(t):
    d = recent(t.v_readings, "ts", 365 * 24).groupBy("zone_id", "field", F.to_date("ts").alias("day")).agg(F.avg("value").alias("m"))
    return d.groupBy("zone_id", "field", F.trunc("day", "month").alias("month")).agg(F.round(F.avg("m"), 6).alias("mean"))


PIV = ", ".join(f"round(avg(value) FILTER (field='{p}'),6) AS {p}" for p in POLLUTANTS)


@query("agg_hourly_features", f"SELECT zone_id, date_trunc('hour',ts) AS hour, {PIV} FROM v_readings WHERE ts >= $NOW - INTERVAL 168 HOUR GROUP BY 1,2")
def _(t):
    return hourly(recent(t.v_readings, "ts", 168), POLLUTANTS).select("zone_id", "hour", *r6(*POLLUTANTS))


@query("agg_sensor_hour_mean", f"SELECT sensor_id, {PIV} FROM v_readings WHERE ts >= $NOW - INTERVAL 1 HOUR GROUP BY 1")
def _(t):
    return rollup.pivot(recent(t.v_readings, "ts", 1), ["sensor_id"], POLLUTANTS).select("sensor_id", *r6(*POLLUTANTS))


@query("agg_zone_snapshot", """SELECT date_trunc('hour',ts) AS computed_at, z.zone_id, round(z.lat_c,6) AS lat, round(z.lon_c,6) AS lon, round(avg(value),6) AS pm25_mean FROM v_readings r JOIN v_zones z USING (zone_id) WHERE field='pm25' GROUP BY 1,2,3,4""")
def _(t):
    return kriging.snapshots(t.v_readings, t.v_zones).select(
        "computed_at", "zone_id", *r6("lat", "lon"), F.round("v", 6).alias("pm25_mean"))


@query("agg_city_mean", "SELECT field, count(*) AS n, round(avg(value),6) AS mean FROM v_readings WHERE ts >= $NOW - INTERVAL 24 HOUR GROUP BY 1")
def _(t):
    return recent(t.v_readings, "ts", 24).groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("agg_messages_today", "SELECT sensor_id, count(*) AS n FROM v_readings WHERE field='pm25' AND ts >= date_trunc('day', $NOW - INTERVAL 1 SECOND) GROUP BY 1")
def _(t):
    midnight = F.date_trunc("day", now() - F.expr("INTERVAL '1' SECOND")).cast(NTZ)
    return t.v_readings.where((F.col("field") == "pm25") & (F.col("ts") >= midnight)).groupBy("sensor_id").agg(F.count("*").alias("n"))


@query("agg_rate_per_minute", """SELECT m AS minute, coalesce(n,0) AS n FROM generate_series($NOW - INTERVAL 60 MINUTE, $NOW - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE) g(m)
LEFT JOIN (SELECT date_trunc('minute',ts) AS m, count(*) AS n FROM v_readings GROUP BY 1) c USING (m)""")
def _(t):
    return rollup.per_minute(t.v_readings, "ts", now(), 60).select(F.col("minute").cast(NTZ).alias("minute"), "n")


@query("agg_zone_counts", "SELECT zone_id, count(*) AS n FROM v_readings GROUP BY 1")
def _(t):
    return t.v_readings.groupBy("zone_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "zone_id")


@query("agg_sensor_counts", "SELECT zone_id, count(*) AS total, count(*) FILTER (status='active') AS active FROM v_sensors GROUP BY 1")
def _(t):
    return t.v_sensors.groupBy("zone_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"))


@query("agg_conditional_rates", """SELECT round(100.0E0*count(*) FILTER (r2_score>0.5E0)/greatest(count(*),1),1) AS success_pct, round(100.0E0*count(*) FILTER (r2_score<=0.5E0)/greatest(count(*),1),1) AS low_pct,
 round(100.0E0*count(*) FILTER (r2_score<0.3E0)/greatest(count(*),1),1) AS fallback_pct, (SELECT round(100.0E0*count(*) FILTER (seq>900)/greatest(count(*),1),1) FROM v_readings WHERE ts >= $NOW - INTERVAL 24 HOUR) AS stale_pct,
 (SELECT round(least(count(*)/1000*100,100),6) FROM v_readings WHERE ts >= $NOW - INTERVAL 5 MINUTE) AS load_pct FROM v_calibration""")
def _(t):
    r, n = F.col("r2_score"), F.count("*")
    c = t.v_calibration.agg(pct(F.count_if(r > 0.5), n).alias("success_pct"), pct(F.count_if(r <= 0.5), n).alias("low_pct"),
                            pct(F.count_if(r < 0.3), n).alias("fallback_pct"))
    s = recent(t.v_readings, "ts", 24).agg(pct(F.count_if(F.col("seq") > 900), n).alias("stale_pct"))
    l = t.v_readings.where(F.col("ts") >= now() - F.expr("INTERVAL '5' MINUTE")).agg(
        F.round(F.least(n / 1000 * 100, F.lit(100.0)), 6).alias("load_pct"))
    return one_row([c, s, l])


@query("agg_structural_violations", """SELECT id, zone_id, CASE WHEN detected_value=0 THEN 'stuck_sensor' ELSE 'implausible_ratio' END AS rule FROM v_anomalies WHERE detected_at >= $NOW - INTERVAL 24 HOUR AND (detected_value=0 OR duration_minutes>120)""")
def _(t):
    a = recent(t.v_anomalies, "detected_at", 24)
    return a.where((F.col("detected_value") == 0) | (F.col("duration_minutes") > 120)).select(
        "id", "zone_id", F.when(F.col("detected_value") == 0, "stuck_sensor").otherwise("implausible_ratio").alias("rule"))


@query("agg_per_sensor_messages", "SELECT sensor_id, count(*) AS n, max(ts) AS last_message FROM v_readings WHERE ts >= $NOW - INTERVAL 24 HOUR GROUP BY 1 ORDER BY n DESC, sensor_id LIMIT 50")
def _(t):
    return recent(t.v_readings, "ts", 24).groupBy("sensor_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_message")).orderBy(
        F.desc("n"), "sensor_id").limit(50)


@query("agg_calibration_by_pollutant", "SELECT pollutant, round(avg(r2_score),6) AS avg_r2, count(*) AS n FROM v_calibration GROUP BY 1")
def _(t):
    return t.v_calibration.groupBy("pollutant").agg(F.round(F.avg("r2_score"), 6).alias("avg_r2"), F.count("*").alias("n"))


@query("agg_recent_r2", "SELECT round(avg(r2_score),3) AS avg_r2, count(*) AS n FROM (SELECT * FROM v_calibration ORDER BY valid_from DESC, id DESC LIMIT 15)")
def _(t):
    return t.v_calibration.orderBy(F.desc("valid_from"), F.desc("id")).limit(15).agg(
        F.round(F.avg("r2_score"), 3).alias("avg_r2"), F.count("*").alias("n"))


@query("agg_calibrated_sensors", "SELECT sensor_id, max(valid_from) AS last_calibration, count(*) AS n FROM v_calibration WHERE valid_from >= (SELECT max(valid_from) FROM v_calibration) - INTERVAL 24 HOUR GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def _(t):
    c = t.v_calibration
    newest = c.agg(F.max("valid_from").alias("_now"))
    return c.where(F.col("valid_from") >= newest.scalar() - hours(24)).groupBy("sensor_id").agg(
        F.max("valid_from").alias("last_calibration"), F.count("*").alias("n")).orderBy(F.desc("last_calibration"), "sensor_id").limit(30)


@query("agg_feature_coverage", """SELECT f.zone_id, count(*) AS n_rows, count(pm25_rolling_mean_1h) AS non_null, round(100.0E0*count(pm25_rolling_mean_1h)/greatest(count(*),1),1) AS pct,
 (SELECT round(100.0E0*(SELECT count(DISTINCT zone_id) FROM v_features)/greatest(count(*),1),1) FROM v_zones WHERE niveau=3) AS zones_pct FROM v_features f GROUP BY 1""")
def _(t):
    f = t.v_features
    z = one_row([t.v_zones.where(F.col("niveau") == 3).agg(F.count("*").alias("_z")), f.agg(F.count_distinct("zone_id").alias("_f"))]).select(pct(F.col("_f"), F.col("_z")).alias("zones_pct"))
    n = F.count("pm25_rolling_mean_1h")
    return attach(f.groupBy("zone_id").agg(F.count("*").alias("n_rows"), n.alias("non_null"), pct(n, F.count("*")).alias("pct")), z)


@query("agg_kriging_coverage", """WITH g AS (SELECT z.zone_id, z.lat_c, z.lon_c, r.value FROM v_readings r JOIN v_zones z USING (zone_id) WHERE field='pm25')
SELECT zone_id, count(*) AS n, round(avg(value),6) AS mean, round(stddev_samp(value),6) AS sd, round((SELECT min(lat_c) FROM g),6) AS lat_min, round((SELECT max(lon_c) FROM g),6) AS lon_max,
 (SELECT count(DISTINCT zone_id) FROM g) AS zones_covered FROM g GROUP BY 1""")
def _(t):
    g = t.v_readings.where(F.col("field") == "pm25").join(t.v_zones, "zone_id")
    whole = g.agg(F.round(F.min("lat_c"), 6).alias("lat_min"), F.round(F.max("lon_c"), 6).alias("lon_max"), F.count_distinct("zone_id").alias("zones_covered"))
    return attach(g.groupBy("zone_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"),
                                           F.round(F.stddev_samp("value"), 6).alias("sd")), whole)


@query("agg_horizon_metrics", """SELECT horizon_minutes, count(*) AS n, round(sqrt(avg(pow(predicted_value - CASE WHEN prediction_id % 2 = 0 THEN 50 END,2))),6) AS rmse FROM v_predictions WHERE created_at >= $NOW - INTERVAL 168 HOUR GROUP BY 1""")
def _(t):
    e = F.col("predicted_value") - F.when(F.col("prediction_id") % 2 == 0, 50)
    return recent(t.v_predictions, "created_at", 168).groupBy("horizon_minutes").agg(
        F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


@query("agg_prediction_summary", "SELECT zone_id, count(*) AS n, max(created_at) AS last_at, round(avg(predicted_value),6) AS mean FROM v_predictions WHERE created_at >= $NOW - INTERVAL 24 HOUR GROUP BY 1 ORDER BY n DESC, zone_id LIMIT 30")
def _(t):
    return recent(t.v_predictions, "created_at", 24).groupBy("zone_id").agg(
        F.count("*").alias("n"), F.max("created_at").alias("last_at"), F.round(F.avg("predicted_value"), 6).alias("mean")).orderBy(F.desc("n"), "zone_id").limit(30)


@query("agg_top_entities", "SELECT entity_type, entity_value, count(*) AS n FROM v_entities GROUP BY 1,2 ORDER BY n DESC, entity_value LIMIT 30")
def _(t):
    return t.v_entities.groupBy("entity_type", "entity_value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_value").limit(30)


@query("agg_urgency_distribution", "SELECT coalesce(u,'non_classe') AS urgency, count(*) AS n FROM (SELECT CASE WHEN k >= 80 THEN 'high' WHEN k >= 50 THEN 'medium' WHEN k >= 10 THEN 'low' END AS u FROM (SELECT CAST(json_extract_string(metadata,'$.k') AS INTEGER) AS k FROM v_log)) GROUP BY 1")
def _(t):
    k = F.get_json_object("metadata", "$.k").cast("int")
    doc = t.v_log.select(F.to_json(F.struct(F.when(k >= 80, "high").when(k >= 50, "medium").when(k >= 10, "low").alias("urgency"))).alias("metadata"))
    return doc.groupBy(F.coalesce(F.get_json_object("metadata", "$.urgency"), F.lit("non_classe")).alias("urgency")).agg(F.count("*").alias("n"))


@query("agg_correlation_rate", "SELECT count(*) AS n, round(100*avg(CASE WHEN report_id IN (SELECT doc_id FROM labels) THEN 1.0E0 ELSE 0 END),6) AS pct FROM v_reports WHERE created_at >= $NOW - INTERVAL 168 HOUR")
def _(t):
    l = t.labels.select(F.col("doc_id").alias("report_id")).distinct().withColumn("hit", F.lit(1.0))
    return recent(t.v_reports.select("report_id", "created_at"), "created_at", 168).join(l, "report_id", "left").agg(
        F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))) * 100, 6).alias("pct"))


@query("agg_report_rollup", """WITH e AS (SELECT report_id, string_agg(DISTINCT entity_value, ',' ORDER BY entity_value) AS entities FROM v_entities GROUP BY 1)
SELECT r.report_id, coalesce(e.entities,'') AS entities, r.report_id IN (SELECT doc_id FROM labels) AS correlated, CASE WHEN length(left(texte,100))=100 THEN left(texte,100)||'...' ELSE texte END AS excerpt,
 round(round_even(lon/0.005E0,0)*0.005E0,6) AS lon, round(round_even(lat/0.005E0,0)*0.005E0,6) AS lat FROM v_reports r LEFT JOIN e USING (report_id)""")
def _(t):
    from ..functions.geo import snap
    e = t.v_entities.groupBy("report_id").agg(F.sort_array(F.collect_set("entity_value")).alias("e"))
    l = t.labels.select(F.col("doc_id").alias("report_id")).distinct().withColumn("hit", F.lit(True))
    r = t.v_reports.select("report_id", text.excerpt(F.col("texte")).alias("excerpt"),
                           *[F.round(snap(F.col(c), 0.005), 6).alias(c) for c in ("lon", "lat")])
    return r.join(e, "report_id", "left").join(l, "report_id", "left").select(
        "report_id", F.array_join(F.coalesce("e", F.array().cast("array<string>")), ",").alias("entities"),
        F.coalesce("hit", F.lit(False)).alias("correlated"), "excerpt", "lon", "lat")


@query("agg_ordered_array", """SELECT type, coalesce(string_agg(name, ',' ORDER BY training_end DESC, name DESC) FILTER (training_end > $NOW - INTERVAL 24 HOUR),'') AS names, max(training_end) AS last_run FROM v_models GROUP BY 1""")
def _(t):
    new = F.when(F.col("training_end") > now() - hours(24), F.struct("training_end", "name"))
    return t.v_models.groupBy("type").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(new), False), lambda x: x["name"]), ",").alias("names"),
        F.max("training_end").alias("last_run"))


@query("agg_quality_coverage", "SELECT round((SELECT count(*) FROM v_readings WHERE ts >= $NOW - INTERVAL 1 HOUR)/CAST((3600//30)*(SELECT count(*) FROM v_sensors WHERE status='active') AS DOUBLE),3) AS q1_coverage")
def _(t):
    from ..operators import quality
    return quality.coverage(recent(t.v_readings, "ts", 1), t.v_sensors)


@query("agg_quality_calibration", "SELECT round((SELECT count(*) FROM v_readings WHERE field='pm25' AND value>10 AND ts >= $NOW - INTERVAL 24 HOUR)/CAST(greatest((SELECT count(*) FROM v_readings WHERE field='pm25' AND ts >= $NOW - INTERVAL 24 HOUR),1) AS DOUBLE),3) AS q2_calibration_rate")
def _(t):
    from ..operators import quality
    raw = recent(t.v_readings, "ts", 24).where(F.col("field") == "pm25")
    return quality.calibration_rate(raw, raw.where(F.col("value") > 10))


@query("agg_rmse", """SELECT horizon_minutes, count(*) AS n, round(sqrt(avg(pow(abs(p.predicted_value-r.value),2))),6) AS rmse FROM v_predictions p JOIN v_readings r ON r.reading_id=p.prediction_id-1 WHERE horizon_minutes IN (60,1440) AND created_at >= $NOW - INTERVAL 168 HOUR GROUP BY 1""")
def _(t):
    from ..operators import quality
    p = recent(t.v_predictions, "created_at", 168).withColumn("rid", F.col("prediction_id") - 1).join(
        t.v_readings.select(F.col("reading_id").alias("rid"), F.col("value").alias("actual_value")), "rid")
    return quality.rmse(p, (60, 1440)).select("horizon_minutes", "n", *r6("rmse"))


@query("agg_false_alarm_rate", "SELECT round(coalesce(count(*) FILTER (statut_envoi='cancelled')/CAST(nullif(count(*),0) AS DOUBLE),0),6) AS q5_false_alarm_rate FROM v_alerts WHERE created_at > (SELECT max(created_at) FROM v_alerts) - INTERVAL 24 HOUR")
def _(t):
    from ..operators import quality
    a = t.v_alerts
    newest = a.agg(F.max("created_at").alias("_now"))
    day = a.where(F.col("created_at") > newest.scalar() - hours(24))
    return quality.false_alarm_rate(day).select(F.round("q5_false_alarm_rate", 6).alias("q5_false_alarm_rate"))


@query("agg_latency_p95", "SELECT round(quantile_cont((epoch_us($NOW)-epoch_us(ts))//1000, 0.95)+1e-6,1) AS q6_latency_p95_ms FROM v_readings WHERE ts >= $NOW - INTERVAL 24 HOUR")
def _(t):
    from ..operators import quality
    q = quality.latency_p95(recent(t.v_readings, "ts", 24), now())
    return q.select(F.round(F.col("q6_latency_p95_ms") + 1e-6, 1).alias("q6_latency_p95_ms"))


@query("agg_prophet_hourly", """WITH h AS (SELECT zone_id, date_trunc('hour',ts) AS ds, greatest(0, avg(value)) AS y FROM v_readings WHERE field='pm25' GROUP BY 1,2)
SELECT zone_id, ds, round(y,6) AS y FROM h WHERE y IS NOT NULL AND zone_id IN (SELECT zone_id FROM h GROUP BY 1 HAVING count(*) >= 70)""")
def _(t):
    from ..operators import models
    return models.hourly_series(hourly(t.v_readings, ["pm25"]), least=70).select("zone_id", "ds", *r6("y"))  # the given events are sparse


#: The default gate of 168 hours, on series per residue class of zones, which have enough hours.
@query("agg_prophet_hourly_week", """WITH h AS (SELECT zone_id % 4 AS zone_id, date_trunc('hour',ts) AS ds, greatest(0, avg(value)) AS y FROM v_readings WHERE field='pm25' GROUP BY 1,2)
SELECT zone_id, ds, round(y,6) AS y FROM h WHERE y IS NOT NULL AND zone_id IN (SELECT zone_id FROM h GROUP BY 1 HAVING count(*) >= 168)""")
def _(t):
    from ..operators import models
    wide = t.v_readings.withColumn("zone_id", F.col("zone_id") % 4)
    return models.hourly_series(hourly(wide, ["pm25"])).select("zone_id", "ds", *r6("y"))


@query("agg_deploy_checks", """SELECT 'sensor' AS check_name, CAST(sensor_id AS VARCHAR) AS key, count(*) AS n FROM v_readings WHERE ts >= $NOW - INTERVAL 6 HOUR GROUP BY 2 UNION ALL
SELECT 'sensor_zone', sensor_id||'/'||zone_id, count(*) FROM v_readings WHERE ts >= $NOW - INTERVAL 3 HOUR GROUP BY 2 UNION ALL SELECT 'zone_pollutant', zone_id||'/'||field, count(*) FROM v_readings WHERE ts >= $NOW - INTERVAL 12 HOUR GROUP BY 2 UNION ALL
SELECT 'zone_high', CAST(zone_id AS VARCHAR), 1 FROM (SELECT zone_id, arg_max(value, ts) AS v FROM v_readings WHERE field='pm25' GROUP BY 1) WHERE v > 35""")
def _(t):
    from ..operators import quality
    return quality.deploy_checks(t.v_readings, now(), (6, 3, 12), 35.0)


@query("agg_ingest_per_min_kpi", """WITH m AS (SELECT m, coalesce(n,0) AS n FROM generate_series($NOW - INTERVAL 60 MINUTE, $NOW - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE) g(m) LEFT JOIN (SELECT date_trunc('minute',ts) AS m, count(*) AS n FROM v_readings GROUP BY 1) c USING (m))
SELECT CAST(sum(n) AS BIGINT) AS total, CAST(round(avg(n)) AS BIGINT) AS per_minute FROM m""")
def _(t):
    return rollup.per_minute(t.v_readings, "ts", now(), 60).agg(F.sum("n").alias("total"), F.round(F.avg("n")).cast("long").alias("per_minute"))
