"""Stream jobs, run over the given tables as streams that end when the input is used up."""

from pyspark.sql import functions as F

from ..operators import messages
from ..session import shared_dir
from ..streaming import jobs, run, state
from ..streaming.keyed import KeyedTable
from ..streaming.watchdog import STATE, silence_stream
from . import views
from .registry import query
from .views import now
from .windows_q import COOL_SQL, KALMAN_SQL

NTZ = "timestamp_ntz"


def stream(t, view):
    """A stand-in view over ``events`` as a stream, with zoned timestamps."""
    src = run.files(t.spark, t.sf_dir, t.events.schema, glob="events.parquet")
    name = f"stream_events_{abs(hash(t.sf_dir))}"
    src.createOrReplaceTempView(name)
    d = t.spark.sql(views.VIEW_SQL[view].replace("FROM events", f"FROM {name}"))
    return d.withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "detected_at", "created_at") if c in d.columns})


def table(t, s, name, **kw):
    path, _ = run.to_table(s, name, **kw)
    return t.spark.read.schema(s.schema).parquet(path)


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast(NTZ) for c in cols})


VALID = """CASE WHEN broken THEN 'json_parse_error' WHEN coalesce(regexp_full_match(sensor_id,'ESP32-DK-[A-Z]+-[0-9]{3}') AND humidity BETWEEN 0 AND 100 AND temperature BETWEEN -10 AND 60 AND seq>=0, false) THEN NULL ELSE 'validation_error' END"""


@query("src_message_stream", "SELECT event_id, 'city/sensors/'||sensor_id||'/data' AS topic, NOT broken AS parsed FROM v_messages")
def _(t):
    p = messages.parse(messages.from_rows(stream(t, "v_messages"))).select("event_id", "topic", F.col("msg").isNotNull().alias("parsed"))
    return table(t, p, "messages")


@query("sink_append_batched", "SELECT CAST(ts AS DATE) AS date, count(*) AS n, round(sum(value),4) AS total FROM v_readings GROUP BY 1")
def _(t):
    s = stream(t, "v_readings").withColumn("date", F.to_date("ts"))
    return table(t, s, "append", partition="date").groupBy("date").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


#: Accepted rows with zone and stale flag, and dead letters; both come from one pass over the stream.
@query("st_ingest", f"""WITH v AS (SELECT *, {VALID} AS error FROM v_messages), o AS (SELECT *, max(seq) OVER (PARTITION BY sensor_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM v WHERE error IS NULL),
k AS (SELECT DISTINCT 'ESP32-DK-CLICK-' || right('00'||CAST(sensor_id AS VARCHAR),3) AS sensor_id, min('n'||zone_id) AS slug FROM v_sensors GROUP BY 1)
SELECT 'accepted' AS outcome, o.event_id, o.sensor_id, o.seq, CASE WHEN o.ts IS NOT NULL THEN coalesce(k.slug, lower(split_part(o.sensor_id,'-',3))) END AS zone, abs(epoch_us($NOW)-epoch_us(ts)) > 300000000 AS stale, round(pm25,4) AS pm25, NULL AS details FROM o LEFT JOIN k USING (sensor_id) WHERE m IS NULL OR seq>m
UNION ALL SELECT 'rejected', event_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN broken THEN 'not valid JSON' ELSE 'failed: ' || array_to_string(list_filter([CASE WHEN regexp_full_match(sensor_id,'ESP32-DK-[A-Z]+-[0-9]{{3}}') THEN NULL ELSE 'sensor_id' END, CASE WHEN seq>=0 THEN NULL ELSE 'seq' END,
 CASE WHEN humidity BETWEEN 0 AND 100 THEN NULL ELSE 'humidity' END, CASE WHEN coalesce(temperature BETWEEN -10 AND 60, false) THEN NULL ELSE 'temperature' END], lambda x: x IS NOT NULL), ', ') END FROM v WHERE error IS NOT NULL""")
def _(t):
    known = t.v_sensors.select(F.concat(F.lit("ESP32-DK-CLICK-"), F.lpad(F.col("sensor_id").cast("string"), 3, "0")).alias("sensor_id"),
                               F.concat(F.lit("n"), F.col("zone_id").cast("string")).alias("slug")).groupBy("sensor_id").agg(F.min("slug").alias("slug"))
    path = jobs.ingest(messages.from_rows(stream(t, "v_messages")), known, seen_at=now().cast("timestamp"))
    d = t.spark.read.parquet(path)
    return d.select("outcome", "event_id", "sensor_id", "seq", "zone", "stale", F.round("pm25", 4).alias("pm25"), "details")


@query("st_seq_dedup", """SELECT reading_id, sensor_id, seq FROM (SELECT *, max(seq) OVER (PARTITION BY sensor_id ORDER BY ts, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM v_readings) WHERE m IS NULL OR seq > m""")
def _(t):
    s = state.seq_dedup(stream(t, "v_readings"), "sensor_id", "seq", ["ts", "reading_id"])
    return table(t, s, "dedup").select("reading_id", "sensor_id", "seq")


@query("st_dead_letter_rate", f"""WITH v AS (SELECT ts, {VALID} AS error FROM v_messages) SELECT w AS window_start, count(*) AS messages, count(error) AS rejects, count(error)/CAST(count(*) AS DOUBLE)>0.05E0 AND count(error)>=5 AS warn
FROM (SELECT date_trunc('hour',ts) - INTERVAL 1 HOUR * i AS w, error FROM v, range(5) r(i)) GROUP BY 1""")
def _(t):
    m = messages.validate(messages.parse(messages.from_rows(t.v_messages)))
    return jobs.dead_letter_rate(m, "5 hours", "1 hour")


RATE_SQL = f"""WITH v AS (SELECT ts, {VALID} AS error FROM v_messages) SELECT w AS window_start, count(*) AS messages, count(error) AS rejects, count(error)/CAST(count(*) AS DOUBLE)>0.05E0 AND count(error)>=5 AS warn
FROM (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 1 MINUTE * i AS w, error FROM v, range(5) r(i)) GROUP BY 1"""


def keyed(t, name, keys, **kw):
    return KeyedTable(t.spark, shared_dir(t.spark, name), keys, **kw)


#: The windows of five minutes, each minute, as a stream whose table holds the newest state of every window.
@query("st_dead_letter_rate_stream", RATE_SQL)
def _(t):
    m = messages.validate(messages.parse(messages.from_rows(stream(t, "v_messages"))))
    table = keyed(t, "dead-rate", ["window_start"])
    jobs.into_keyed(jobs.dead_letter_rate(m), table, "dead-rate")
    return ntz(table.read(), "window_start")


@query("st_freshness_stream", """SELECT sensor_id, w + INTERVAL 10 MINUTE AS checked_at, max(ts) AS last_ts, CAST(1 AS INTEGER) AS is_fresh FROM (SELECT sensor_id, ts, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * i AS w FROM v_readings, range(2) r(i) WHERE field='pm25') GROUP BY 1,2""")
def _(t):
    table = keyed(t, "freshness", ["sensor_id", "checked_at"])
    jobs.into_keyed(jobs.freshness(stream(t, "v_readings")), table, "freshness")
    return ntz(table.read(), "checked_at", "last_ts")


@query("st_touch_sensor_stream", """SELECT s.sensor_id, greatest(b.seen, s.last_seen) AS last_seen, CASE WHEN b.seen IS NOT NULL THEN 'active' ELSE s.status END AS status, b.battery, b.rssi FROM v_sensors s
LEFT JOIN (SELECT sensor_id, max(ts) AS seen, CAST(arg_max(seq % 101, ts) FILTER (seq % 7 <> 0) AS VARCHAR) AS battery, CAST(arg_max(-seq % 90, ts) AS VARCHAR) AS rssi FROM v_readings GROUP BY 1) b USING (sensor_id)""")
def _(t):
    r = stream(t, "v_readings").select("sensor_id", "ts", F.when(F.col("seq") % 7 != 0, F.col("seq") % 101).alias("battery"), (-F.col("seq") % 90).alias("rssi"))
    table = keyed(t, "touch", ["sensor_id"])
    jobs.into_keyed(jobs.touches(r), table, "touch")
    s = t.v_sensors.withColumn("last_seen", F.col("last_seen").cast("timestamp")).withColumn("metadata", F.create_map(F.lit("site"), F.lit("roof")))
    d = jobs.touched(s, table.read())
    return ntz(d.select("sensor_id", "last_seen", "status", F.col("metadata")["battery_pct"].alias("battery"), F.col("metadata")["rssi_dbm"].alias("rssi")), "last_seen")


#: Silences of 10 and 30 hours (the stand-in sensors report rarely), each reported at its own time once the watermark has passed it.
@query("st_watchdog_stream", """WITH d AS (SELECT DISTINCT sensor_id, ts FROM v_readings), l AS (SELECT sensor_id, ts, lag(ts) OVER w AS prev, lead(ts) OVER w AS nxt FROM d WINDOW w AS (PARTITION BY sensor_id ORDER BY ts)),
m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 MINUTE AS mark FROM d), e AS (SELECT l.*, mark, least(coalesce(nxt - INTERVAL 1 MICROSECOND, mark), mark) AS until FROM l, m WHERE ts <= mark)
SELECT sensor_id, ts AS at, 'active' AS status FROM e WHERE prev IS NULL OR ts - prev > INTERVAL 10 HOUR UNION ALL SELECT sensor_id, ts + INTERVAL 10 HOUR, 'inactive' FROM e WHERE ts + INTERVAL 10 HOUR <= until
UNION ALL SELECT sensor_id, ts + INTERVAL 30 HOUR, 'dropout' FROM e WHERE ts + INTERVAL 30 HOUR <= until""")
def _(t):
    s = silence_stream(stream(t, "v_readings").select("sensor_id", "ts"), 600, 1800)
    return ntz(table(t, s, "silence", conf=STATE).select("sensor_id", F.timestamp_micros("at_us").alias("at"), "status"), "at")


@query("st_touch_sensor", """SELECT s.sensor_id, coalesce(b.seen, s.last_seen) AS last_seen, CASE WHEN b.seen IS NOT NULL THEN 'active' ELSE s.status END AS status, b.battery FROM v_sensors s
LEFT JOIN (SELECT sensor_id, max(ts) AS seen, CAST(arg_max(seq % 101, ts) AS VARCHAR) AS battery FROM v_readings WHERE ts >= $NOW - INTERVAL 24 HOUR GROUP BY 1) b USING (sensor_id)""")
def _(t):
    b = t.v_readings.where(F.col("ts") >= now() - F.expr("INTERVAL '24' HOUR")).select(
        "sensor_id", "ts", (F.col("seq") % 101).alias("battery"), (-F.col("seq") % 90).alias("rssi"))
    s = t.v_sensors.withColumn("metadata", F.create_map(F.lit("site"), F.lit("roof")))
    return jobs.touch(s, b).select("sensor_id", "last_seen", "status", F.col("metadata")["battery_pct"].alias("battery"))


@query("st_watchdog", "SELECT sensor_id, CASE WHEN status='active' AND last_seen < $NOW - INTERVAL 600 MINUTE THEN 'inactive' ELSE status END AS status, last_seen < $NOW - INTERVAL 1800 MINUTE AS dropout FROM v_sensors")
def _(t):
    return jobs.watchdog(t.v_sensors, now(), 600, 1800)


@query("st_freshness", """SELECT sensor_id, w + INTERVAL 10 MINUTE AS checked_at, max(ts) AS last_ts, CAST(1 AS INTEGER) AS is_fresh FROM (SELECT sensor_id, ts, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * i AS w FROM v_readings, range(2) r(i) WHERE field='pm25') GROUP BY 1,2""")
def _(t):
    return jobs.freshness(t.v_readings)


@query("st_state_persist", f"WITH RECURSIVE {KALMAN_SQL} SELECT reading_id, sensor_id, round(x,6) AS x FROM k")
def _(t):
    s = stream(t, "v_readings").where(F.col("field") == "pm25")
    mid = F.lit("2024-01-16").cast("timestamp")
    first = table(t, state.kalman(s.where(F.col("ts") < mid), "sensor_id", "ts", "reading_id", "value"), "kalman-1")
    saved = first.groupBy("sensor_id").agg(F.max_by(F.struct("x", "p"), F.struct("ts", "reading_id")).alias("s")).select("sensor_id", "s.*")
    second = table(t, state.kalman(s.where(F.col("ts") >= mid), "sensor_id", "ts", "reading_id", "value", initial=saved), "kalman-2")
    return first.unionByName(second).select("reading_id", "sensor_id", F.round("x", 6).alias("x"))


@query("st_lookback_batch", "SELECT reading_id, round(greatest(0, 0.85E0*value-1.2E0),6) AS calibrated FROM v_readings")
def _(t):
    s = jobs.late_calibration(stream(t, "v_readings"), "reading_id").select("reading_id", F.round("calibrated", 6).alias("calibrated"))
    return table(t, s, "late")


@query("st_tumbling_rollup", """SELECT * FROM (SELECT zone_id, field AS pollutant, date_trunc('hour',ts) AS window_start, date_trunc('hour',ts)+INTERVAL 1 HOUR AS window_end, count(*) AS n, round(avg(value),6) AS mean, round(min(value),6) AS min, round(max(value),6) AS max,
 round(stddev_samp(value),6) AS stddev, round(quantile_disc(value,0.5),6) AS p50, round(quantile_disc(value,0.95),6) AS p95, count(DISTINCT sensor_id) AS sensor_count FROM v_readings GROUP BY 1,2,3,4)
WHERE window_end <= (SELECT max(ts) FROM v_readings) - INTERVAL 5 MINUTE""")
def _(t):
    s = jobs.tumbling_rollup(stream(t, "v_readings"))
    return ntz(table(t, s, "rollup"), "window_start", "window_end").select(
        "zone_id", "pollutant", "window_start", "window_end", "n", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max", "stddev", "p50", "p95")], "sensor_count")


@query("st_threshold_alerts", """WITH thr(field, w, d) AS (VALUES ('pm25',50.1E0,100.1E0),('pm10',155E0,255E0),('co',9.5E0,12.5E0),('no2',101E0,361E0),('o3',71E0,86E0))
SELECT ts, sensor_id, field AS pollutant, CASE WHEN value>=d THEN 'danger' ELSE 'warning' END AS severity FROM v_readings JOIN thr USING (field) WHERE value>=w""")
def _(t):
    return ntz(table(t, jobs.threshold_alerts(stream(t, "v_readings")), "threshold"), "ts").select("ts", "sensor_id", "pollutant", "severity")


@query("st_alert_cooldown", f"WITH RECURSIVE {COOL_SQL} SELECT zone_id, t AS detected_at FROM r")
def _(t):
    return ntz(table(t, state.cooldown(stream(t, "v_anomalies"), ["zone_id"], "detected_at", 1800), "cooldown"), "detected_at")


@query("st_rule_throttle", """WITH RECURSIVE a AS (SELECT DISTINCT sensor_id, ts AS t FROM v_readings), n AS MATERIALIZED (SELECT x.sensor_id, x.t, min(b.t) AS nxt FROM a x JOIN a b ON x.sensor_id=b.sensor_id AND b.t >= x.t + INTERVAL 5 MINUTE GROUP BY 1,2),
r AS (SELECT sensor_id, min(t) AS t FROM a GROUP BY 1 UNION ALL SELECT r.sensor_id, n.nxt FROM r JOIN n ON n.sensor_id=r.sensor_id AND n.t=r.t) SELECT sensor_id, t AS ts FROM r""")
def _(t):
    return ntz(table(t, state.cooldown(stream(t, "v_readings"), ["sensor_id"], "ts", 300), "throttle"), "ts")


@query("st_model_reload", """SELECT reading_id, (SELECT max(id) FROM v_calibration) AS model_version, round(greatest(0, (SELECT arg_max(coef_a,id) FROM v_calibration)*value + (SELECT arg_max(coef_b,id) FROM v_calibration)),6) AS calibrated FROM v_readings""")
def _(t):
    registry, out = shared_dir(t.spark, "registry"), shared_dir(t.spark, "calibrated")
    t.v_calibration.select(F.col("id").alias("version"), "coef_a", "coef_b").write.parquet(registry)
    jobs.calibrate_with_newest(stream(t, "v_readings"), registry, out)
    return t.spark.read.parquet(out).select("reading_id", "model_version", F.round("calibrated", 6).alias("calibrated"))


@query("st_live_counters", "SELECT zone_id, field, count(*) AS n, max(ts) AS last_ts FROM v_readings GROUP BY 1,2")
def _(t):
    counters = jobs.live_counters(stream(t, "v_readings"), shared_dir(t.spark, "counters"))
    return ntz(counters.read(), "last_ts").select("zone_id", "field", "n", "last_ts")
