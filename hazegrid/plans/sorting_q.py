"""Sorts, limits, top-k and set operations."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.aqi import POLLUTANTS, daily_subindex
from ..operators import rollup, supervise
from .registry import query
from .scalars_q import DAILY_SQL
from .views import now


@query("srt_page", """SELECT id, created_at, (SELECT count(*) FROM v_alerts) AS total, (SELECT CAST(greatest(ceil(count(*)/25), 1) AS BIGINT) FROM v_alerts) AS pages
FROM v_alerts ORDER BY created_at DESC, id LIMIT 25 OFFSET 50""")
def _(t):
    return supervise.page(t.v_alerts, "created_at", "id", page=3, size=25).select("id", "created_at", "total", "pages")


@query("srt_nulls_last", "SELECT id, name, training_end FROM v_models ORDER BY training_end DESC NULLS LAST, id LIMIT 50")
def _(t):
    return t.v_models.orderBy(F.desc_nulls_last("training_end"), "id").limit(50).select("id", "name", "training_end")


@query("srt_json_int", """WITH k AS (SELECT id, CAST(json_extract_string(metadata,'$.k') AS INTEGER) AS k FROM v_log)
SELECT id, k, (SELECT CAST(sum(k) AS BIGINT) FROM k) AS total FROM k ORDER BY k DESC NULLS LAST, id LIMIT 20""")
def _(t):
    k = t.v_log.select("id", F.get_json_object("metadata", "$.k").cast("int").alias("k"))
    return supervise.attach(k.orderBy(F.desc_nulls_last("k"), "id").limit(20), k.agg(F.sum("k").alias("total")))


@query("srt_topk", "SELECT zone_id, count(*) AS n FROM v_anomalies GROUP BY 1 ORDER BY n DESC, zone_id LIMIT 12")
def _(t):
    return t.v_anomalies.groupBy("zone_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "zone_id").limit(12)


@query("srt_recent_series", """SELECT id, computed_at, round(q1_coverage,6) AS q1 FROM (SELECT * FROM v_metrics ORDER BY computed_at DESC, id DESC LIMIT 48)""")
def _(t):
    return supervise.recent_series(t.v_metrics, "computed_at", "id", 48).select(
        "id", "computed_at", F.round("q1_coverage", 6).alias("q1"))


@query("srt_topk_per_key", """SELECT zone_id, id, detected_at, rank FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY detected_at DESC, id DESC) AS rank FROM v_anomalies)
WHERE rank <= 10""")
def _(t):
    w = W.partitionBy("zone_id").orderBy(F.col("detected_at").desc(), F.col("id").desc())
    return (t.v_anomalies.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 10)
            .select("zone_id", "id", "detected_at", "rank"))


@query("srt_pending_batch", """SELECT report_id, created_at FROM v_reports WHERE nlp_status='pending' ORDER BY created_at, report_id LIMIT 100""")
def _(t):
    return (t.v_reports.where(F.col("nlp_status") == "pending").orderBy("created_at", "report_id").limit(100)
            .select("report_id", "created_at"))


@query("set_union_stats", """WITH h AS (SELECT zone_id, field AS pollutant, date_trunc('day', ts) AS day, avg(value) AS mean, min(value) AS mn, max(value) AS mx FROM v_readings GROUP BY 1,2,3)
SELECT zone_id, pollutant, day, 'mean' AS stat, round(mean,6) AS value FROM h UNION ALL SELECT zone_id, pollutant, day, 'min', round(mn,6) FROM h
UNION ALL SELECT zone_id, pollutant, day, 'max', round(mx,6) FROM h""")
def _(t):
    h = t.v_readings.groupBy("zone_id", F.col("field").alias("pollutant"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        *[F.round(f("value"), 6).alias(n) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    return h.unpivot(["zone_id", "pollutant", "day"], ["mean", "min", "max"], "stat", "value")


@query("set_union_subindices", f"WITH {DAILY_SQL} SELECT zone_id, day, max(iqa) AS iqa_value, count(iqa) AS n_pollutants FROM s GROUP BY 1,2")
def _(t):
    # one scan: the means of a zone's day side by side, then one row per pollutant
    m = rollup.pivot(t.v_readings.withColumn("day", F.to_date("ts")), ["zone_id", "day"], list(POLLUTANTS))
    parts = m.select("zone_id", "day", F.explode(F.array(*[daily_subindex(p, F.col(p)) for p in POLLUTANTS])).alias("iqa"))
    return parts.groupBy("zone_id", "day").agg(F.max("iqa").alias("iqa_value"), F.count("iqa").alias("n_pollutants"))


@query("set_union_events", """WITH f AS (SELECT 'anomaly_detector' AS service, 'WARN' AS level, 'Anomaly: ' || pollutant || ' = ' || CAST(CAST(detected_value AS DECIMAL(12,2)) AS VARCHAR) || ' in zone ' || split_part(path,'.',-1) AS message,
  '{"anomaly_id":' || id || '}' AS metadata, detected_at AS created_at, 1 AS kind, id FROM v_anomalies JOIN v_zones USING (zone_id) WHERE detected_at > $NOW - INTERVAL 24 HOUR
UNION ALL SELECT 'alerts', 'INFO', 'Alert: ' || gravite || ' [' || type || '] — ' || message, '{"alert_id":' || id || '}', created_at, 2, id FROM v_anomaly_alerts JOIN v_zones USING (zone_id) WHERE created_at > $NOW - INTERVAL 24 HOUR
UNION ALL SELECT 'monitoring', 'INFO', 'Quality check: ' || metrics, metrics, computed_at, 3, id FROM v_metrics WHERE computed_at > $NOW - INTERVAL 24 HOUR)
SELECT service, level, message, metadata, created_at, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, kind, id LIMIT 50 OFFSET 10""")
def _(t):
    return supervise.event_feed(t.v_anomalies, t.v_anomaly_alerts, t.v_metrics, t.v_zones, now(), limit=50, offset=10)


@query("set_concat_sources", """SELECT source, count(*) AS n, round(avg(pm25_raw),6) AS raw, round(avg(pressure),6) AS pressure, round(avg(hour),6) AS hour FROM (
 SELECT 'uci' AS source, value AS pm25_raw, 1013.0E0 AS pressure, CAST(hour(ts) AS INTEGER) AS hour FROM v_readings WHERE field='co'
 UNION ALL SELECT 'stations', value, 1013.0E0, 12 FROM v_readings WHERE field='pm25'
 UNION ALL SELECT 'weather', wind_speed, pressure, CAST(hour(ts) AS INTEGER) FROM v_weather) GROUP BY 1""")
def _(t):
    r = t.v_readings
    return supervise.concat_sources({
        "uci": r.where(F.col("field") == "co").select(F.col("ts").alias("timestamp"), F.col("value").alias("pm25_raw")),
        "stations": r.where(F.col("field") == "pm25").select(F.col("value").alias("pm25_raw")),
        "weather": t.v_weather.select(F.col("ts").alias("timestamp"), F.col("wind_speed").alias("pm25_raw"), "pressure"),
    }).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("pm25_raw"), 6).alias("raw"),
                             F.round(F.avg("pressure"), 6).alias("pressure"), F.round(F.avg("hour"), 6).alias("hour"))


@query("set_distinct_zones", "SELECT DISTINCT zone_id FROM v_sensors WHERE status='active'")
def _(t):
    return t.v_sensors.where(F.col("status") == "active").select("zone_id").distinct()
