"""Joins."""

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import govern, joins, kriging, messages, polygons, scan
from .registry import query
from .scalars_q import AZ_SQL, HAV_SQL
from .views import now


@query("join_inner_dim", """SELECT z.nom, r.field, count(*) AS n, round(avg(r.value),6) AS mean FROM v_readings r JOIN v_sensors s ON s.sensor_id=r.sensor_id JOIN v_zones z ON z.zone_id=s.zone_id
WHERE s.status='active' GROUP BY 1,2""")
def _(t):
    s = t.v_sensors.where(F.col("status") == "active").select("sensor_id", "zone_id")
    return (t.v_readings.drop("zone_id").join(s, "sensor_id").join(t.v_zones.select("zone_id", "nom"), "zone_id")
            .groupBy("nom", "field").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")))


@query("join_left_multi", """SELECT a.id, z.nom, s.status, al.gravite FROM v_anomalies a JOIN v_zones z USING (zone_id) LEFT JOIN v_sensors s ON s.sensor_id=a.sensor_id LEFT JOIN v_anomaly_alerts al ON al.anomaly_id=a.id""")
def _(t):
    a = t.v_anomalies.select("id", "zone_id", "sensor_id")
    return (a.join(t.v_zones.select("zone_id", "nom"), "zone_id").join(t.v_sensors.select("sensor_id", "status"), "sensor_id", "left")
            .join(t.v_anomaly_alerts.select(F.col("anomaly_id").alias("id"), "gravite"), "id", "left")
            .select("id", "nom", "status", "gravite"))


@query("join_left_conditional", """WITH c AS (SELECT *, CASE WHEN r2_score < 0.5E0 THEN valid_from + INTERVAL 90 DAY END AS valid_until FROM v_calibration)
SELECT s.s_suppkey AS sensor_id, c.id, c.valid_from + INTERVAL 90 DAY > TIMESTAMP '2001-10-01' AS is_recent FROM supplier s LEFT JOIN c ON c.sensor_id=s.s_suppkey AND c.valid_until IS NULL""")
def _(t):
    c = t.v_calibration.withColumn("valid_until", F.when(F.col("r2_score") < 0.5, F.col("valid_from") + F.expr("INTERVAL '90' DAY")))
    s = t.supplier.select(F.col("s_suppkey").alias("sid"))
    recent = F.col("valid_from") + F.expr("INTERVAL '90' DAY") > F.lit("2001-10-01").cast("timestamp_ntz")
    return s.join(c, (F.col("sid") == F.col("sensor_id")) & F.col("valid_until").isNull(), "left").select(
        F.col("sid").alias("sensor_id"), "id", recent.alias("is_recent"))


@query("join_lookup_fallback", """WITH k AS (SELECT 'ESP32-DK-CLICK-' || right('00'||CAST(sensor_id AS VARCHAR),3) AS serial, 'n'||zone_id AS slug FROM v_sensors WHERE sensor_id < 1000)
SELECT m.event_id, coalesce(k.slug, CASE WHEN len(string_split(m.sensor_id,'-'))>=4 THEN lower(split_part(m.sensor_id,'-',3)) ELSE 'unknown' END) AS slug FROM v_messages m LEFT JOIN k ON k.serial=m.sensor_id""")
def _(t):
    k = t.v_sensors.where(F.col("sensor_id") < 1000).select(
        F.concat(F.lit("ESP32-DK-CLICK-"), F.lpad(F.col("sensor_id").cast("string"), 3, "0")).alias("serial"),
        F.concat(F.lit("n"), F.col("zone_id").cast("string")).alias("known"))
    j = t.v_messages.join(k, F.col("serial") == F.col("sensor_id"), "left")
    return j.select("event_id", F.coalesce("known", messages.slug_from_serial(F.col("sensor_id"))).alias("slug"))


@query("join_dense_zones", """WITH m AS (SELECT zone_id, avg(value) AS pm25, max(ts) AS fresh FROM v_readings WHERE field='pm25' AND ts >= $NOW - INTERVAL 6 HOUR GROUP BY 1),
c AS (SELECT zone_id, count(*) AS n FROM v_anomalies WHERE detected_at >= $NOW - INTERVAL 24 HOUR GROUP BY 1)
SELECT z.zone_id, z.nom, round(m.pm25,6) AS pm25, m.fresh, coalesce(c.n,0) AS anomalies FROM v_zones z LEFT JOIN m USING (zone_id) LEFT JOIN c USING (zone_id) WHERE z.niveau=3""")
def _(t):
    m = t.v_readings.where((F.col("field") == "pm25") & (F.col("ts") >= now() - F.expr("INTERVAL '6' HOUR"))).groupBy("zone_id").agg(
        F.avg("value").alias("pm25"), F.max("ts").alias("fresh"))
    c = t.v_anomalies.where(F.col("detected_at") >= now() - F.expr("INTERVAL '24' HOUR")).groupBy("zone_id").agg(F.count("*").alias("n"))
    z = t.v_zones.where(F.col("niveau") == 3).select("zone_id", "nom")
    return z.join(m, "zone_id", "left").join(c, "zone_id", "left").select(
        "zone_id", "nom", F.round("pm25", 6).alias("pm25"), "fresh", F.coalesce("n", F.lit(0)).alias("anomalies"))


def _pm25(t):
    return t.v_readings.where(F.col("field") == "pm25").select("reading_id", "zone_id", "ts")


@query("join_asof_weather", """SELECT r.reading_id, w.temperature, w.humidity, w.event_id AS weather_id FROM (SELECT * FROM v_readings WHERE field='pm25') r
ASOF LEFT JOIN v_weather w ON r.zone_id=w.zone_id AND r.ts >= w.ts""")
def _(t):
    w = t.v_weather.withColumn("weather_id", F.col("event_id"))
    return scan.asof(_pm25(t), w, ["zone_id"], "ts", "ts", ["event_id"], ["temperature", "humidity", "weather_id"]).select(
        "reading_id", "temperature", "humidity", "weather_id")


@query("join_asof_traffic", """SELECT r.reading_id, a.congestion_level AS congestion, b.congestion_level AS congestion_lag_1h FROM (SELECT *, ts - INTERVAL 1 HOUR AS ts1 FROM v_readings WHERE field='pm25') r
ASOF LEFT JOIN v_traffic a ON r.zone_id=a.zone_id AND r.ts >= a.ts ASOF LEFT JOIN v_traffic b ON r.zone_id=b.zone_id AND r.ts1 >= b.ts""")
def _(t):
    w = t.v_traffic
    a = scan.asof(_pm25(t), w.withColumn("congestion", F.col("congestion_level")), ["zone_id"], "ts", "ts", ["event_id"], ["congestion"])
    a = a.withColumn("ts1", F.col("ts") - F.expr("INTERVAL '1' HOUR"))
    b = scan.asof(a, w.withColumn("congestion_lag_1h", F.col("congestion_level")), ["zone_id"], "ts1", "ts", ["event_id"], ["congestion_lag_1h"])
    return b.select("reading_id", "congestion", "congestion_lag_1h")


@query("join_interval_avg", """SELECT r.reading_id, round(avg(w.congestion_level),6) AS congestion_mean_3h FROM (SELECT * FROM v_readings WHERE field='pm25') r
LEFT JOIN v_traffic w ON r.zone_id=w.zone_id AND w.ts BETWEEN r.ts - INTERVAL 3 HOUR AND r.ts GROUP BY 1""")
def _(t):
    m = joins.interval_mean(_pm25(t), "reading_id", t.v_traffic, ["zone_id"], "ts", "ts", "congestion_level", 3 * 3600, "m")
    return m.select("reading_id", F.round("m", 6).alias("congestion_mean_3h"))


@query("join_nearest_tolerance", """WITH f AS (SELECT user_id % 25 AS zone_id, ts, event_id, coalesce(CASE WHEN event_type='click' THEN value END, value*2) AS v FROM events),
c AS (SELECT p.prediction_id, f.v, row_number() OVER (PARTITION BY p.prediction_id ORDER BY abs(epoch_us(f.ts)-epoch_us(p.target_timestamp)), f.ts, f.event_id) AS rn
 FROM v_predictions p JOIN f ON f.zone_id=p.zone_id AND f.ts BETWEEN p.target_timestamp - INTERVAL 30 MINUTE AND p.target_timestamp + INTERVAL 30 MINUTE WHERE p.target_timestamp <= $NOW - INTERVAL 1 HOUR)
SELECT p.prediction_id, round(c.v,6) AS actual_value FROM v_predictions p LEFT JOIN c ON c.prediction_id=p.prediction_id AND rn=1 WHERE p.target_timestamp <= $NOW - INTERVAL 1 HOUR""")
def _(t):
    e = t.events
    f = e.select((F.col("user_id") % 25).alias("zone_id"), "ts", "event_id",
                 F.coalesce(F.when(F.col("event_type") == "click", F.col("value")), F.col("value") * 2).alias("actual_value"))
    p = t.v_predictions.where(F.col("target_timestamp") <= now() - F.expr("INTERVAL '1' HOUR")).select(
        "prediction_id", "zone_id", "target_timestamp")
    n = joins.nearest(p, f, ["zone_id"], "target_timestamp", "ts", ["event_id"], "actual_value", 1800)
    return n.select("prediction_id", F.round("actual_value", 6).alias("actual_value"))


@query("join_lag_asof", """WITH h AS (SELECT zone_id, date_trunc('hour', ts) AS hour, avg(value) AS m FROM v_readings WHERE field='pm25' GROUP BY 1,2)
SELECT a.zone_id, a.hour, round(b.m,6) AS lag_1h, round(c.m,6) AS lag_24h FROM h a LEFT JOIN h b ON b.zone_id=a.zone_id AND b.hour=a.hour - INTERVAL 1 HOUR LEFT JOIN h c ON c.zone_id=a.zone_id AND c.hour=a.hour - INTERVAL 24 HOUR""")
def _(t):
    from ..operators.windows import hour_lags, hourly
    h = hourly(t.v_readings, ["pm25"])
    return hour_lags(h, {"pm25": [1, 24]}).select("zone_id", "hour", F.round("pm25_lag_1h", 6).alias("lag_1h"),
                                                  F.round("pm25_lag_24h", 6).alias("lag_24h"))


@query("join_time_aligned", """WITH w AS (SELECT sensor_id, field, time_bucket(INTERVAL 5 MINUTE, ts) AS w, avg(value) AS m FROM v_readings GROUP BY 1,2,3)
SELECT a.sensor_id, a.w AS window_start, round(a.m,6) AS raw, round(b.m,6) AS reference FROM w a JOIN w b ON a.sensor_id=b.sensor_id AND a.w=b.w WHERE a.field='pm25' AND b.field='pm10'""")
def _(t):
    from ..operators.rollup import series
    g = lambda f, n: series(t.v_readings.where(F.col("field") == f), "5 minutes", ["sensor_id"]).select(
        "sensor_id", "window_start", F.round("mean", 6).alias(n))
    return g("pm25", "raw").join(g("pm10", "reference"), ["sensor_id", "window_start"])


@query("join_point_in_polygon", """SELECT r.report_id, min(z.zone_id) AS zone_id FROM v_reports r LEFT JOIN v_zones z ON r.lon BETWEEN z.lon_c-z.half AND z.lon_c+z.half AND r.lat BETWEEN z.lat_c-z.half AND z.lat_c+z.half AND z.niveau=3 GROUP BY 1""")
def _(t):
    return joins.locate(t.v_reports.select("report_id", "lon", "lat"), t.v_zones).select("report_id", "zone_id")


@query("join_point_deepest_zone", """WITH z AS (SELECT zone_id, niveau, lon_c, lat_c, half FROM v_zones UNION ALL SELECT 100, 1, -17.45E0, 14.70E0, 0.08E0)
SELECT report_id, coalesce(zone_id, 1) AS zone_id FROM (SELECT r.report_id, z.zone_id, row_number() OVER (PARTITION BY r.report_id ORDER BY niveau DESC, z.zone_id) AS rn FROM v_reports r
LEFT JOIN z ON r.lon BETWEEN z.lon_c-z.half AND z.lon_c+z.half AND r.lat BETWEEN z.lat_c-z.half AND z.lat_c+z.half) WHERE rn=1""")
def _(t):
    z = t.v_zones.select("zone_id", "niveau", "lon_c", "lat_c", "half")
    region = t.region.agg(F.lit(100).cast("long").alias("zone_id"), F.lit(1).alias("niveau"), F.lit(-17.45).alias("lon_c"),
                          F.lit(14.70).alias("lat_c"), F.lit(0.08).alias("half"))
    p = joins.locate(t.v_reports.select("report_id", "lon", "lat"), z.unionByName(region), pick="deepest")
    return p.select("report_id", F.coalesce("zone_id", F.lit(1)).alias("zone_id"))


#: Even-odd rule by brute force: every point against every border piece.
EDGE_SQL = """e AS (SELECT zone_id, niveau, ring, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2
 FROM v_zone_vertices WINDOW w AS (PARTITION BY zone_id, ring ORDER BY k)),
ar AS (SELECT zone_id, sum(CASE WHEN ring=0 THEN s ELSE -s END) AS area FROM (SELECT zone_id, ring, abs(sum(x1*y2-x2*y1))/2 AS s FROM e GROUP BY 1,2) GROUP BY 1)"""
HIT_SQL = "SELECT p.report_id, e.zone_id, e.niveau FROM {p} p JOIN e ON (e.y1>p.lat)<>(e.y2>p.lat) AND p.lon < e.x1+(p.lat-e.y1)*(e.x2-e.x1)/(e.y2-e.y1) GROUP BY 1,2,3 HAVING count(*)%2=1"


def zone_polygons(t):
    return polygons.rings(t.v_zone_vertices, ["zone_id", "niveau"])


@query("join_polygon_zones", f"""WITH {EDGE_SQL}, h AS ({HIT_SQL.format(p='v_reports')})
SELECT r.report_id, CAST(count(h.zone_id) AS INTEGER) AS n_zones, arg_min(h.zone_id, area) FILTER (h.niveau=3) AS smallest, arg_min(h.zone_id, h.zone_id - 1000*h.niveau) AS deepest
FROM v_reports r LEFT JOIN h USING (report_id) LEFT JOIN ar ON ar.zone_id=h.zone_id GROUP BY 1""")
def _(t):
    p = polygons.containing(t.v_reports.select("report_id", "lon", "lat"), zone_polygons(t))
    z = F.col("zones")
    return p.select("report_id", F.coalesce(F.size(z), F.lit(0)).alias("n_zones"), polygons.smallest(z).alias("smallest"), polygons.deepest(z).alias("deepest"))


@query("join_spatiotemporal", f"""WITH n AS (SELECT r.report_id, r.created_at, z.zone_id, {HAV_SQL.format(lat1='r.lat', lon1='r.lon', lat2='z.lat_c', lon2='z.lon_c')} AS km FROM v_reports r CROSS JOIN v_zones z)
SELECT report_id, anomaly_id, rank, round(km,6) AS km FROM (SELECT n.report_id, n.km, a.id AS anomaly_id, CAST(row_number() OVER (PARTITION BY n.report_id ORDER BY a.detected_at DESC, a.id DESC) AS INTEGER) AS rank
FROM n JOIN v_anomalies a ON a.zone_id=n.zone_id AND a.detected_at BETWEEN n.created_at - INTERVAL 2 HOUR AND n.created_at + INTERVAL 30 MINUTE WHERE km <= 2) WHERE rank<=10""")
def _(t):
    m = joins.spatiotemporal(t.v_reports, t.v_anomalies, t.v_zones)
    return m.select("report_id", "anomaly_id", "rank", F.round("km", 6).alias("km"))


SECTOR_SQL = f"""WITH w AS (SELECT zone_id, arg_max(wind_direction, ts) AS wd FROM v_weather GROUP BY 1), m AS (SELECT zone_id, avg(value) AS m FROM v_readings WHERE field='pm25' AND ts >= $NOW - INTERVAL 24 HOUR GROUP BY 1),
p AS (SELECT a.zone_id, w.wd, m.m, {AZ_SQL.format(x1='a.lon_c', y1='a.lat_c', x2='b.lon_c', y2='b.lat_c')} AS az FROM v_zones a JOIN v_zones b ON a.zone_id<>b.zone_id AND a.niveau=b.niveau JOIN w ON w.zone_id=a.zone_id JOIN m ON m.zone_id=b.zone_id)
SELECT zone_id, round(avg(m),6) AS mean FROM p WHERE abs(fmod(az-(wd+{{off}})+180+720,360)-180) <= 45 GROUP BY 1"""


def _sector(t, off):
    w = t.v_weather.groupBy("zone_id").agg(F.max_by("wind_direction", "ts").alias("wind_direction"))
    m = t.v_readings.where((F.col("field") == "pm25") & (F.col("ts") >= now() - F.expr("INTERVAL '24' HOUR"))).groupBy("zone_id").agg(F.avg("value").alias("mean"))
    return joins.sector_mean(t.v_zones, w, m, offset=off, out="m").select("zone_id", F.round("m", 6).alias("mean"))


@query("join_upwind_sector", SECTOR_SQL.format(off=0))
def _(t):
    return _sector(t, 0.0)


@query("join_downwind_sector", SECTOR_SQL.format(off=180))
def _(t):
    return _sector(t, 180.0)


@query("join_semi_exists", "SELECT report_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=report_id) AS correlated FROM v_reports")
def _(t):
    l = t.labels.select(F.col("doc_id").alias("report_id")).distinct().withColumn("hit", F.lit(True))
    return t.v_reports.select("report_id").join(l, "report_id", "left").select(
        "report_id", F.coalesce("hit", F.lit(False)).alias("correlated"))


@query("join_anti_silent", "SELECT sensor_id FROM v_sensors WHERE sensor_id NOT IN (SELECT sensor_id FROM v_readings WHERE field='pm25' AND ts >= $NOW - INTERVAL 24 HOUR)")
def _(t):
    fresh = t.v_readings.where((F.col("field") == "pm25") & (F.col("ts") >= now() - F.expr("INTERVAL '24' HOUR")))
    return joins.silent(t.v_sensors, fresh, "sensor_id").select("sensor_id")


@query("join_cross_grid", f"""WITH s AS (SELECT zone_id, lon_c, lat_c, avg(value) AS m FROM v_readings JOIN v_zones USING (zone_id) WHERE field='pm25' GROUP BY 1,2,3),
g AS (SELECT i, j, 14.60E0+0.22E0*i/199 AS lat, -17.58E0+0.28E0*j/199 AS lon FROM range(200) a(i), range(200) b(j))
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(m*exp(-(pow(lat-lat_c,2)+pow(lon-lon_c,2))/(2*0.05E0*0.05E0))),3) AS kernel_sum FROM g CROSS JOIN s GROUP BY 1,2""")
def _(t):
    s = t.v_readings.where(F.col("field") == "pm25").groupBy("zone_id").agg(F.avg("value").alias("m")).join(t.v_zones, "zone_id")
    st = s.agg(F.sort_array(F.collect_list(F.struct(F.col("lat_c").alias("lat"), F.col("lon_c").alias("lon"), F.col("m").alias("w")))).alias("stations"))
    g = kriging.grid_rows(st)
    return g.select("i", "j", F.round(kriging.kernel_sum(F.col("stations"), F.col("lat"), F.col("lon"), 0.05), 3).alias("kernel_sum"))


@query("join_update_from", """SELECT c.id, CASE WHEN c.id % 3 = 0 AND s.segment IS NOT NULL THEN true ELSE c.data_consent END AS data_consent FROM v_citizens c LEFT JOIN (SELECT DISTINCT segment FROM v_citizens) s USING (segment)""")
def _(t):
    users = t.v_citizens.select("id", F.when(F.col("id") % 3 == 0, F.lit(True)).alias("data_consent"))
    return govern.update_from(t.v_citizens.select("id", "data_consent"), users, "id", ["data_consent"])


@query("join_in_list", "SELECT id, zone_id FROM v_alerts WHERE zone_id IN (SELECT zone_id FROM v_sensors WHERE status='inactive')")
def _(t):
    z = t.v_sensors.where(F.col("status") == "inactive").select("zone_id").distinct()
    return t.v_alerts.join(z, "zone_id", "left_semi").select("id", "zone_id")
