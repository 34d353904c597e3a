"""Scans, sources, sinks and retention."""

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import readers, sinks
from ..operators import messages, rollup
from .registry import query
from .views import now


@query("src_time_range_scan", """SELECT reading_id, ts, field, round(value,6) AS value FROM v_readings
WHERE ts >= $NOW - INTERVAL 168 HOUR AND ts < $NOW AND field IN ('pm25','pm10')""")
def _(t):
    return readers.time_range(t.v_readings, "ts", now(), 168, ("pm25", "pm10")).select(
        "reading_id", "ts", "field", F.round("value", 6).alias("value"))


@query("src_table", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(t):
    return readers.table(t.spark, f"{t.sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("src_csv_training", """SELECT ts AS timestamp, round(temperature,6) AS temperature, round(wind_speed,6) AS pm25_raw, CAST(hour(ts) AS INTEGER) AS hour FROM v_weather""")
def _(t):
    path = shared_dir(t.spark, "training-csv")
    t.v_weather.select(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), "temperature",
        "humidity", "pressure", F.col("wind_speed").alias("pm25_raw"), F.lit(None).cast("double").alias("pm25_true"),
        F.hour("ts").alias("hour")).write.csv(path, header=True)
    return readers.training_csv(t.spark, path).select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.round("temperature", 6).alias("temperature"),
        F.round("pm25_raw", 6).alias("pm25_raw"), "hour")


@query("src_csv_locale", """SELECT date_trunc('second', ts) AS timestamp, round(round(value,4)/1164.6E0,8) AS co_ref, CAST(sensor_id AS DOUBLE) AS temperature
FROM v_readings WHERE seq % 11 <> 0""")
def _(t):
    path = shared_dir(t.spark, "locale-csv")
    comma = lambda c: F.regexp_replace(c.cast("string"), r"\.", ",")
    t.v_readings.select(
        F.date_format(F.col("ts").cast("timestamp"), "dd/MM/yyyy").alias("Date"),
        F.date_format(F.col("ts").cast("timestamp"), "HH.mm.ss").alias("Time"),
        comma(F.when(F.col("seq") % 11 == 0, -200.0).otherwise(F.round("value", 4)).cast("decimal(18,4)")).alias("CO(GT)"),
        comma(F.col("sensor_id")).alias("T"), F.lit("").alias("_e1"), F.lit("").alias("_e2")).write.csv(path, header=True, sep=";")
    return readers.locale_csv(t.spark, path, ["Date", "Time", "CO(GT)", "T", "_e1", "_e2"],
                              {"CO(GT)": "co_ref", "T": "temperature"}).select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.round("co_ref", 8).alias("co_ref"), "temperature")


@query("src_openaq_long", """SELECT date_trunc('second', ts) AS timestamp, field AS parameter, round(value,4) AS value, n_name AS city FROM v_readings JOIN nation ON n_nationkey=zone_id
WHERE seq % 13 <> 0""")
def _(t):
    path = shared_dir(t.spark, "openaq")
    j = t.v_readings.join(t.nation, F.col("zone_id") == F.col("n_nationkey"))
    res = lambda v: F.struct(
        F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc")).alias("date"),
        F.col("field").alias("parameter"), v.alias("value"), F.lit("µg/m³").alias("unit"))
    v = F.round("value", 4).cast("decimal(18,4)").cast("string")
    (j.select(F.lit("XX").alias("country"), F.col("n_name").alias("city"),
              F.struct(F.lit(14.7).alias("latitude"), F.lit(-17.4).alias("longitude")).alias("coordinates"),
              F.array(res(F.when(F.col("seq") % 13 == 0, "-1").otherwise(v)), res(F.lit("n/a")),
                      res(F.lit(None).cast("string"))).alias("results")).write.json(path))
    return readers.openaq_long(t.spark, path).select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "parameter", F.round("value", 4).alias("value"), "city")


@query("src_feature_store", """SELECT zone_id, ts AS timestamp, round(pm25_rolling_mean_1h,6) AS pm25, n_points FROM
(SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY ts DESC) AS rn FROM v_features) WHERE rn <= 288""")
def _(t):
    names = ["pm25_rolling_mean_1h", "n_points"]
    store = t.v_features.select("zone_id", F.col("ts").cast("timestamp_ntz").alias("timestamp"),
                                F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("features"))
    return readers.feature_rows(store, names).select(
        "zone_id", "timestamp", F.round("pm25_rolling_mean_1h", 6).alias("pm25"), "n_points")


@query("sink_rollup_overwrite", """SELECT CAST(ts AS DATE) AS day, zone_id, field AS pollutant, round(avg(value),6) AS mean FROM v_readings GROUP BY 1,2,3""")
def _(t):
    path = shared_dir(t.spark, "rollup")
    daily = t.v_readings.groupBy(F.to_date("ts").alias("day"), "zone_id", F.col("field").alias("pollutant")).agg(F.avg("value").alias("mean"))
    sinks.overwrite_partitions(daily, path, "day")
    sinks.overwrite_partitions(daily.where(F.col("day") >= "2024-01-20"), path, "day")  # a rerun replaces its days only
    return t.spark.read.schema(daily.schema).parquet(path).select("day", "zone_id", "pollutant", F.round("mean", 6).alias("mean"))


@query("sink_upsert", """WITH u AS (SELECT zone_id, ts, n_points AS v, 0 AS p FROM v_features WHERE ts < $NOW - INTERVAL 2 DAY UNION ALL
 SELECT zone_id, ts, n_points + 1, 1 FROM v_features WHERE ts >= $NOW - INTERVAL 10 DAY)
SELECT zone_id, ts, v FROM (SELECT *, row_number() OVER (PARTITION BY zone_id, ts ORDER BY p DESC) AS rn FROM u) WHERE rn=1""")
def _(t):
    f = t.v_features.select("zone_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("n_points").alias("v"))
    old = f.where(F.col("ts") < now() - F.expr("INTERVAL '2' DAY"))
    new = f.where(F.col("ts") >= now() - F.expr("INTERVAL '10' DAY")).withColumn("v", F.col("v") + 1)
    return sinks.upsert(old, new, ["zone_id", "ts"])


@query("sink_insert_ignore", """SELECT zone_id, ts, v FROM (SELECT zone_id, ts, n_points AS v FROM v_features WHERE ts < $NOW - INTERVAL 2 DAY)
UNION ALL SELECT zone_id, ts, n_points + 1 FROM v_features WHERE ts >= $NOW - INTERVAL 2 DAY""")
def _(t):
    f = t.v_features.select("zone_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("n_points").alias("v"))
    old = f.where(F.col("ts") < now() - F.expr("INTERVAL '2' DAY"))
    new = f.where(F.col("ts") >= now() - F.expr("INTERVAL '10' DAY")).withColumn("v", F.col("v") + 1)
    return sinks.insert_ignore(old, new, ["zone_id", "ts"])


@query("sink_dead_letter", """SELECT error, count(*) AS n FROM (SELECT CASE WHEN broken THEN 'json_parse_error' ELSE 'validation_error' END AS error FROM v_messages
 WHERE broken OR NOT coalesce(regexp_full_match(sensor_id, 'ESP32-DK-[A-Z]+-[0-9]{3}') AND humidity BETWEEN 0 AND 100 AND temperature BETWEEN -10 AND 60 AND seq >= 0, false)) GROUP BY 1""")
def _(t):
    path = shared_dir(t.spark, "dead-letter")
    bad = messages.validate(messages.parse(messages.from_rows(t.v_messages))).where(F.col("error").isNotNull())
    dead = sinks.dead_letters(bad, F.col("ts"))
    dead.write.json(path)
    return t.spark.read.schema(dead.schema).json(path).groupBy("error").agg(F.count("*").alias("n"))


@query("sink_export", """SELECT ts, sensor_id, round(max(CASE WHEN field='pm25' THEN value END),6) AS pm25, round(max(CASE WHEN field='no2' THEN value END),6) AS no2
FROM v_readings WHERE zone_id=7 AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-30' AND field IN ('pm25','no2') GROUP BY 1,2""")
def _(t):
    path = shared_dir(t.spark, "export")
    e = sinks.export(t.v_readings, 7, "2024-01-02", "2024-01-30", ["pm25", "no2"])
    fmt = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "header": "true"}
    e.write.options(**fmt).csv(path)
    back = t.spark.read.schema(e.schema).options(**fmt).csv(path)
    return back.select("ts", "sensor_id", F.round("pm25", 6).alias("pm25"), F.round("no2", 6).alias("no2"))


@query("sink_geojson", """SELECT hour AS computed_at, CAST(count(*) AS INTEGER) AS n_points FROM (SELECT date_trunc('hour', ts) AS hour, zone_id FROM v_readings WHERE field='pm25' GROUP BY 1,2) GROUP BY 1""")
def _(t):
    m = t.v_readings.where(F.col("field") == "pm25").groupBy(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("computed_at"), "zone_id").agg(F.round(F.avg("value"), 6).alias("pm25_mean"))
    s = m.join(t.v_zones.select("zone_id", F.col("lon_c").alias("lon"), F.col("lat_c").alias("lat"),
                                messages.slug(F.col("path")).alias("zone")), "zone_id")
    return sinks.geojson(s, {"grid_size": 200}).where(F.get_json_object("geojson", "$.type") == "FeatureCollection").select(
        "computed_at", "n_points")


@query("sink_model_registry", """WITH a AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY training_end DESC, id DESC) AS rn FROM v_models WHERE is_active AND training_end IS NOT NULL)
SELECT m.name, m.version, m.type, m.id, coalesce(a.rn = 1, false) AS is_active FROM v_models m LEFT JOIN a USING (type, id)""")
def _(t):
    m = t.v_models.select("id", "name", "version", "type", F.when(F.col("is_active"), F.col("training_end")).alias("activated_at"))
    return sinks.register_models(m).select("name", "version", "type", "id", "is_active")


@query("ret_age", "SELECT reading_id, ts FROM v_readings WHERE ts >= $NOW - INTERVAL 168 HOUR")
def _(t):
    return sinks.drop_old(t.v_readings, "ts", now(), 7 * 24).select("reading_id", "ts")


@query("ret_keep_last_n", """SELECT name, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY training_end DESC NULLS LAST, id DESC) AS rn FROM v_models) WHERE rn<=3""")
def _(t):
    return sinks.keep_last_n(t.v_models, "name", "training_end", "id", 3).select("name", "id")
