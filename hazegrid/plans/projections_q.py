"""Projections, filters and predicates."""

from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.timefeat import micros
from ..operators import messages, rollup
from .registry import query
from .views import now

FIELDS = ["pm25", "pm10", "co", "no2", "o3"]


@query("prj_flatten_payload", """
SELECT sensor_id, ts, seq, round(pm25, 6) AS pm25, round(pm10, 6) AS pm10, temperature, humidity,
  user_id % 101 AS battery_level FROM v_messages WHERE NOT broken""")
def _(t):
    m = messages.parse(messages.from_rows(t.v_messages)).where(F.col("msg").isNotNull())
    f = messages.flatten(m)
    return f.select("sensor_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq", F.round("pm25", 6).alias("pm25"),
                    F.round("pm10", 6).alias("pm10"), "temperature", "humidity",
                    F.col("battery_level").cast("long").alias("battery_level"))


@query("flt_validate", """
SELECT status, count(*) AS n FROM (SELECT CASE WHEN broken THEN 'json_parse_error'
  WHEN regexp_full_match(sensor_id, 'ESP32-DK-[A-Z]+-[0-9]{3}') AND humidity BETWEEN 0 AND 100
   AND temperature BETWEEN -10 AND 60 AND seq BETWEEN 0 AND 2147483647 THEN 'valid'
  ELSE 'validation_error' END AS status FROM v_messages) GROUP BY status""")
def _(t):
    m = messages.validate(messages.parse(messages.from_rows(t.v_messages)))
    return m.groupBy(F.coalesce("error", F.lit("valid")).alias("status")).agg(F.count("*").alias("n"))


@query("prj_stale", """
SELECT reading_id, ts, abs(epoch_us(ts + INTERVAL 7 MINUTE * (reading_id % 3)) - epoch_us(ts)) > 300000000 AS stale
FROM v_readings""")
def _(t):
    r = t.v_readings.withColumn("arrived", F.col("ts") + F.make_interval(mins=(F.col("reading_id") % 3 * 7).cast("int")))
    return r.select("reading_id", "ts", messages.stale(F.col("ts"), F.col("arrived")).alias("stale"))


@query("prj_zone_slug", "SELECT zone_id, split_part(path, '.', -1) AS slug FROM v_zones")
def _(t):
    return t.v_zones.select("zone_id", messages.slug(F.col("path")).alias("slug"))


@query("flt_subtree", """
SELECT zone_id, path, split_part(path, '.', -1) = 'n7' AS is_leaf, path LIKE 'root.r1.%' AS under_r1 FROM v_zones
WHERE split_part(path, '.', -1) = 'n7' OR path = 'root.r1' OR path LIKE 'root.r1.%'""")
def _(t):
    p = F.col("path")
    leaf, under = messages.slug(p) == "n7", p.startswith("root.r1.")
    return (t.v_zones.where(leaf | (p == "root.r1") | under)
            .select("zone_id", "path", leaf.alias("is_leaf"), under.alias("under_r1")))


@query("prj_slug_fallback", """
SELECT sensor_id, CASE WHEN len(string_split(sensor_id, '-')) >= 4 THEN lower(split_part(sensor_id, '-', 3))
  ELSE 'unknown' END AS slug, count(*) AS n FROM v_messages GROUP BY 1, 2""")
def _(t):
    return (t.v_messages.select("sensor_id", messages.slug_from_serial(F.col("sensor_id")).alias("slug"))
            .groupBy("sensor_id", "slug").agg(F.count("*").alias("n")))


@query("flt_field_set", """
SELECT reading_id, field, value FROM v_readings WHERE field = 'pm25' OR field = 'pm10'""")
def _(t):
    return t.v_readings.where(F.col("field").isin("pm25", "pm10")).select("reading_id", "field", "value")


@query("flt_optional", """
SELECT id, zone_id, gravite FROM v_alerts WHERE zone_id = 7 AND gravite = 'danger' AND created_at >= TIMESTAMP '1996-01-01'
  AND created_at < TIMESTAMP '2000-01-01'""")
def _(t):
    a = t.v_alerts
    return messages.optional_filter(
        a, zone_id=7, gravite="danger", statut_envoi=None,
        created_from="1996-01-01", created_to="2000-01-01", date_col="created_at").select("id", "zone_id", "gravite")


@query("flt_text_search", """
SELECT id, service, level FROM v_log WHERE message ILIKE '%sensor 1%' AND service = 'ingestion' AND level = 'WARN'""")
def _(t):
    return messages.search_log(t.v_log, service="ingestion", level="warn", search="SENSOR 1").select(
        "id", "service", "level")


@query("flt_json_path", """
SELECT id, CAST(json_extract_string(metadata, '$.k') AS INTEGER) AS k FROM v_log
WHERE json_extract(metadata, '$.k') IS NOT NULL AND CAST(json_extract_string(metadata, '$.k') AS INTEGER) >= 50""")
def _(t):
    k = F.get_json_object("metadata", "$.k")
    return t.v_log.where(k.isNotNull() & (k.cast("int") >= 50)).select("id", k.cast("int").alias("k"))


@query("flt_bbox", """
SELECT count(*) AS n, round(min(v), 6) AS min_value, round(max(v), 6) AS max_value FROM (
  SELECT z.lat_c, z.lon_c, r.value AS v FROM v_readings r JOIN v_zones z USING (zone_id) WHERE field = 'pm25')
WHERE lat_c BETWEEN 14.65 AND 14.75 AND lon_c BETWEEN -17.51 AND -17.39""")
def _(t):
    r = t.v_readings.where(F.col("field") == "pm25").join(t.v_zones, "zone_id")
    box = geo.in_box(F.col("lon_c"), F.col("lat_c"), -17.51, 14.65, -17.39, 14.75)
    return r.where(box).agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("min_value"),
                            F.round(F.max("value"), 6).alias("max_value"))


@query("flt_age_gate", """
SELECT sensor_id, last_seen, last_seen < $NOW - INTERVAL 24 HOUR AS inactive FROM v_sensors
WHERE last_seen >= $NOW - INTERVAL 72 HOUR""")
def _(t):
    age = F.lit(3600_000_000)
    us = micros(now()) - micros(F.col("last_seen"))
    return t.v_sensors.where(us <= age * 72).select("sensor_id", "last_seen", (us > age * 24).alias("inactive"))


@query("flt_sensor_grid", """
SELECT s.sensor_id, z.nom, COALESCE(CASE WHEN s.sensor_id % 7 = 0 THEN NULL ELSE s.sensor_id % 100 END, 0) AS battery
FROM v_sensors s JOIN v_zones z USING (zone_id)
WHERE s.status = 'active' AND COALESCE(CASE WHEN s.sensor_id % 7 = 0 THEN NULL ELSE s.sensor_id % 100 END, 0) >= 20
  AND COALESCE(CASE WHEN s.sensor_id % 5 = 0 THEN NULL ELSE -40 - s.sensor_id % 60 END, -200) >= -90
  AND (CAST(s.sensor_id AS VARCHAR) LIKE '%1%' OR lower(z.nom) LIKE '%1%')""")
def _(t):
    s = (t.v_sensors.join(t.v_zones.select("zone_id", "nom"), "zone_id")
         .withColumn("battery", F.when(F.col("sensor_id") % 7 != 0, F.col("sensor_id") % 100))
         .withColumn("rssi", F.when(F.col("sensor_id") % 5 != 0, -40 - F.col("sensor_id") % 60)))
    return messages.sensor_grid(s, status="active", min_battery=20, min_rssi=-90, needle="1", sort="battery").select(
        "sensor_id", "nom", F.coalesce("battery", F.lit(0)).alias("battery"))


@query("prj_pivot", """
SELECT ts, sensor_id, zone_id, round(max(CASE WHEN field='pm25' THEN value END), 6) AS pm25,
 round(max(CASE WHEN field='pm10' THEN value END), 6) AS pm10, round(max(CASE WHEN field='co' THEN value END), 6) AS co,
 round(max(CASE WHEN field='no2' THEN value END), 6) AS no2, round(max(CASE WHEN field='o3' THEN value END), 6) AS o3
FROM v_readings GROUP BY ts, sensor_id, zone_id""")
def _(t):
    p = rollup.pivot(t.v_readings, ["ts", "sensor_id", "zone_id"], FIELDS, F.max)
    return p.select("ts", "sensor_id", "zone_id", *[F.round(f, 6).alias(f) for f in FIELDS])


@query("prj_pivot_mean", """
SELECT date_trunc('hour', ts) AS hour, zone_id, round(avg(CASE WHEN field='pm25' THEN value END), 6) AS pm25,
 round(avg(CASE WHEN field='pm10' THEN value END), 6) AS pm10, round(avg(CASE WHEN field='co' THEN value END), 6) AS co,
 round(avg(CASE WHEN field='no2' THEN value END), 6) AS no2, round(avg(CASE WHEN field='o3' THEN value END), 6) AS o3
FROM v_readings GROUP BY 1, 2""")
def _(t):
    p = rollup.pivot(t.v_readings.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")),
                     ["hour", "zone_id"], FIELDS)
    return p.select("hour", "zone_id", *[F.round(f, 6).alias(f) for f in FIELDS])


@query("prj_unpivot", """
SELECT zone_id, ts, 'temperature' AS field, temperature AS value FROM v_weather UNION ALL
SELECT zone_id, ts, 'humidity', humidity FROM v_weather UNION ALL
SELECT zone_id, ts, 'wind_speed', round(wind_speed, 6) FROM v_weather""")
def _(t):
    w = t.v_weather.withColumn("wind_speed", F.round("wind_speed", 6))
    return messages.to_long(w, ["zone_id", "ts"], ["temperature", "humidity", "wind_speed"])


@query("prj_default_fill", """
SELECT reading_id, round(CASE WHEN field='pm25' THEN value ELSE 0 END, 6) AS pm25,
 round(CASE WHEN field='pm10' THEN value ELSE 0 END, 6) AS pm10, CAST(0 AS DOUBLE) AS humidity FROM v_readings""")
def _(t):
    wide = t.v_readings.select("reading_id", *[F.when(F.col("field") == f, F.round("value", 6)).alias(f)
                                               for f in ("pm25", "pm10")])
    return messages.align(wide, ["reading_id"], ["pm25", "pm10", "humidity"])


@query("prj_clamp", """
SELECT reading_id, round(greatest(value - 20, 0), 6) AS floored,
 round(least(greatest(value / 100, 0), 1), 6) AS confidence FROM v_readings""")
def _(t):
    return t.v_readings.select("reading_id", F.round(messages.floor0(F.col("value") - 20), 6).alias("floored"),
                               F.round(messages.unit_interval(F.col("value") / 100), 6).alias("confidence"))


@query("prj_excerpt", """
SELECT report_id, CASE WHEN length(left(texte, 100)) = 100 THEN left(texte, 100) || '...' ELSE left(texte, 100) END AS excerpt
FROM v_reports""")
def _(t):
    return t.v_reports.select("report_id", text.excerpt(F.col("texte")).alias("excerpt"))


@query("prj_report_validate", """
SELECT report_id, length(trim(texte, ' ')) BETWEEN 10 AND 500 AS text_ok, lat BETWEEN 14.5E0 AND 14.9E0 AS lat_ok,
 lon BETWEEN -17.6E0 AND -17.2E0 AS lon_ok, langue IN ('fr', 'en') AS kind_ok FROM v_reports""")
def _(t):
    r = t.v_reports
    rules = messages.report_rules(F.col("texte"), F.col("lat"), F.col("lon"), F.col("langue"), kinds=("fr", "en"))
    return r.select("report_id", *[c.alias(n) for n, c in rules.items()])


@query("prj_generated_error", """
SELECT p.prediction_id, round(p.predicted_value - r.value, 6) AS error, round(abs(p.predicted_value - r.value), 6) AS abs_error
FROM v_predictions p JOIN v_readings r ON r.reading_id = p.prediction_id - p.prediction_id % 2""")
def _(t):
    p = t.v_predictions.withColumn("rid", F.col("prediction_id") - F.col("prediction_id") % 2)
    j = p.join(t.v_readings.select(F.col("reading_id").alias("rid"), F.col("value").alias("actual_value")), "rid")
    e = messages.with_error(j)
    return e.select("prediction_id", F.round("error", 6).alias("error"), F.round("abs_error", 6).alias("abs_error"))


@query("prj_radar_norm", """
WITH z AS (SELECT zone_id, avg(CASE WHEN field='pm25' THEN value END) AS pm25, avg(CASE WHEN field='pm10' THEN value END) AS pm10,
  avg(CASE WHEN field='no2' THEN value END) AS no2, avg(CASE WHEN field='co' THEN value END) AS co FROM v_readings GROUP BY 1)
SELECT zone_id, axis, round(coalesce(least(150, v / ref * 100), 0), 6) AS pct FROM (
 SELECT zone_id, 'pm25' AS axis, pm25 AS v, 25 AS ref FROM z UNION ALL SELECT zone_id, 'pm10', pm10, 50 FROM z
 UNION ALL SELECT zone_id, 'no2', no2, 100 FROM z UNION ALL SELECT zone_id, 'co', co, 9 FROM z
 UNION ALL SELECT zone_id, 'temperature', NULL, 40 FROM z UNION ALL SELECT zone_id, 'humidity', NULL, 100 FROM z)""")
def _(t):
    z = rollup.pivot(t.v_readings, ["zone_id"], ["pm25", "pm10", "no2", "co"])
    r = messages.radar(messages.align(z, ["zone_id"], ["pm25", "pm10", "no2", "co", "temperature", "humidity"], fill=None),
                       "zone_id")
    return r.select("zone_id", "axis", F.round("pct", 6).alias("pct"))
