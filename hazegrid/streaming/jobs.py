"""The stream jobs: ingest, calibration, detection, rollup and supervision counters."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefeat import micros
from ..operators import detect, messages, models
from ..operators.supervise import attach
from ..session import shared_dir
from ..sources import sinks
from . import state
from .keyed import KeyedTable
from .run import each_batch, to_table

# fixed values: reject-rate window, limit and least number; silence limits in minutes
DEAD_RATE, DEAD_MIN, SILENT_MIN, DROPOUT_MIN = 0.05, 5, 10, 30
#: Keys over which rejected messages are spread on their way through the keyed state.
REJECT_KEYS = 4096
DEAD = ("timestamp", "error", "details", "raw_payload", "message_topic")


def with_slug(rows: DataFrame, sensors: DataFrame) -> DataFrame:
    """Rows with the ``_slug`` of their sensor, by ``_key``; rejects (``_bad``) meet no sensor, and their own keys keep them spread."""
    known = sensors.select(F.col("sensor_id").alias("_key"), F.lit(False).alias("_bad"), F.col("slug").alias("_slug"))
    return rows.join(known, ["_key", "_bad"], "left")


def ingest(raw: DataFrame, sensors: DataFrame, name: str = "ingest", seen_at: Column | None = None, every: str | None = None,
           path: str | None = None, checkpoint: str | None = None, forget: int | None = None) -> str:
    """Messages to one table of accepted readings and rejects, partitioned by outcome; returns its path.

    The source is read, parsed and validated once. Valid messages pass the sequence check in keyed state, get a stale flag and their zone
    (from the sensor table, else from the identifier); rejects pass through beside them, spread over keys of their own, so
    messages without a readable sensor never gather under one key. Rows reach the table exactly once. With ``path`` and ``checkpoint`` a
    restart goes on with new messages and the kept sequence state.
    """
    checked = messages.validate(messages.parse(raw))
    letter = sinks.dead_letter(F.col("ts") if seen_at is None else seen_at)
    names = [c for c in DEAD if c != "error"]
    flat = messages.flatten(checked.select("*", *[letter[c].alias(c) for c in names], F.col("error").alias("_error")))
    good = F.col("_error").isNull()
    kept = [c for c in ("event_id", "topic") if c in flat.columns]
    fields = [c for c in flat.columns if c not in (*kept, *names, "_error")]
    rows = flat.select(*kept, *[F.when(good, F.col(c)).alias(c) for c in fields], *[F.when(~good, F.col(c)).alias(c) for c in names], F.col("_error").alias("error"))
    bad = F.col("error").isNotNull()
    spread = F.concat(F.lit("#"), F.pmod(F.xxhash64("raw_payload", *kept), F.lit(REJECT_KEYS)).cast("string"))
    keyed = rows.select("*", F.when(bad, spread).otherwise(F.col("sensor_id")).alias("_key"), bad.alias("_bad"))
    fresh = state.seq_dedup(keyed, "_key", "seq", ["event_id"], forget=forget, always="_bad")
    # computed before the join: rows of the keyed state need a projection before they can be shuffled
    seen = F.current_timestamp() if seen_at is None else seen_at
    fresh = fresh.select(*rows.columns, "_key", "_bad", messages.stale(F.col("ts"), seen).alias("stale"))
    zoned = with_slug(fresh, sensors).drop("_key", "_bad")
    zone = F.when(~bad, F.coalesce("_slug", messages.slug_from_serial(F.col("sensor_id"))))
    out = zoned.withColumn("zone", zone).drop("_slug").withColumns({
        "outcome": F.when(bad, "rejected").otherwise("accepted"), "date": F.to_date(F.coalesce("ts", "timestamp"))})
    return to_table(out, name, path, ("outcome", "date"), every, checkpoint)[0]


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """The readings of a table of :func:`ingest`."""
    return spark.read.parquet(path).where(F.col("outcome") == "accepted").drop("outcome", *DEAD)


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """The dead letters of a table of :func:`ingest`."""
    return spark.read.parquet(path).where(F.col("outcome") == "rejected").select(*DEAD)


def dead_letter_rate(checked: DataFrame, width: str = "5 minutes", slide: str = "1 minute", watermark: str | None = "5 minutes") -> DataFrame:
    """Rejects and messages per sliding window, warning above 5 % with at least 5 rejects."""
    d = checked.withWatermark("ts", watermark) if watermark and checked.isStreaming else checked
    n, bad = F.count("*"), F.count_if(F.col("error").isNotNull())
    return d.groupBy(F.window("ts", width, slide).alias("w")).agg(n.alias("messages"), bad.alias("rejects")).select(
        F.col("w.start").alias("window_start"), "messages", "rejects",
        ((F.col("rejects") / F.col("messages") > DEAD_RATE) & (F.col("rejects") >= DEAD_MIN)).alias("warn"))


def touch(sensors: DataFrame, batch: DataFrame) -> DataFrame:
    """Sensor rows after a batch: newest message time, active again, battery and signal merged in."""
    last = batch.groupBy("sensor_id").agg(F.max("ts").alias("_seen"), F.max_by(
        F.create_map(F.lit("battery_pct"), F.col("battery").cast("string"), F.lit("rssi_dbm"), F.col("rssi").cast("string")), "ts").alias("_meta"))
    j = sensors.join(last, "sensor_id", "left")
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    new = F.coalesce("_meta", F.create_map().cast("map<string,string>"))
    return j.select("sensor_id", F.coalesce("_seen", "last_seen").alias("last_seen"),
                    F.when(F.col("_seen").isNotNull(), "active").otherwise(F.col("status")).alias("status"),
                    F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new).alias("metadata"))


def watchdog(sensors: DataFrame, now: Column, silent_min: int = SILENT_MIN, dropout_min: int = DROPOUT_MIN) -> DataFrame:
    """Active but silent sensors become inactive; long-silent ones are listed as dropouts."""
    age = (micros(now) - micros(F.col("last_seen"))) / 60e6
    return sensors.select("sensor_id", F.when((F.col("status") == "active") & (age > silent_min), "inactive").otherwise(F.col("status")).alias("status"),
                          (age > dropout_min).alias("dropout"))


def freshness(readings: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    d = readings.where(F.col("field") == "pm25")
    d = d.withWatermark("ts", watermark) if d.isStreaming else d
    return d.groupBy("sensor_id", F.window("ts", width, slide).alias("w")).agg(F.max("ts").alias("last_ts")).select(
        "sensor_id", F.col("w.end").alias("checked_at"), "last_ts", F.lit(1).alias("is_fresh"))


def tumbling_rollup(readings: DataFrame, every: str = "1 hour", late: str = "5 minutes") -> DataFrame:
    """Windows leave once no message up to ``late`` behind can change them."""
    v = F.col("value")
    return readings.withWatermark("ts", late).groupBy("zone_id", F.col("field").alias("pollutant"), F.window("ts", every).alias("w")).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("stddev"),
        F.approx_percentile(v, F.array(F.lit(0.5), F.lit(0.95)), F.lit(10000)).alias("q"), F.hll_sketch_estimate(F.hll_sketch_agg(F.col("sensor_id").cast("string"), F.lit(14))).alias("sensor_count")).select(
        "zone_id", "pollutant", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean", "min", "max", "stddev",
        F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), "sensor_count")


def late_calibration(readings: DataFrame, id_col: str, late: str = "90 seconds") -> DataFrame:
    """Calibrated readings, each once: source offsets replace re-reading, and copies are dropped."""
    return readings.withWatermark("ts", late).dropDuplicatesWithinWatermark([id_col]).withColumn(
        "calibrated", models.linear_calibration(F.col("value")))


def threshold_alerts(readings: DataFrame) -> DataFrame:
    return detect.threshold_findings(readings)


def calibrate_with_newest(readings: DataFrame, registry: str, out: str, name: str = "model-reload", every: str | None = None,
                          checkpoint: str | None = None):
    """Each micro-batch reads the newest model row again, so a new model is used without a restart.

    Output stands under the checkpoint's own folder and the batch number: a batch that is run again replaces its own rows only,
    and a start from a new checkpoint touches nothing older.
    """
    checkpoint = checkpoint or shared_dir(readings.sparkSession, f"{name}-checkpoint")
    run = _run_of(checkpoint)

    def apply(batch: DataFrame, batch_id: int) -> None:
        model = batch.sparkSession.read.parquet(registry).orderBy(F.desc("version")).limit(1).select(
            F.col("version").alias("model_version"), "coef_a", "coef_b")
        fit = models.linear_calibration(F.col("value"), F.col("coef_a"), F.col("coef_b"))
        attach(batch, model).withColumn("calibrated", fit).drop("coef_a", "coef_b").write.mode("overwrite").parquet(f"{out}/run={run}/batch={batch_id}")

    return each_batch(readings, name, apply, every=every, checkpoint=checkpoint)


def into_keyed(changes: DataFrame, table: KeyedTable, name: str, every: str | None = None, checkpoint: str | None = None):
    """Rows that a stream changes replace the table's rows of their keys: retries and late rows correct what was written before."""
    return each_batch(changes, name, table.write, mode="update", every=every, checkpoint=checkpoint)


def live_counters(readings: DataFrame, out: str, name: str = "counters", every: str | None = None, checkpoint: str | None = None, compact_every: int = 16) -> KeyedTable:
    """Running totals per zone and pollutant; a trigger writes the totals that changed."""
    table = KeyedTable(readings.sparkSession, out, ["zone_id", "field"], every=compact_every)
    into_keyed(readings.groupBy("zone_id", "field").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")), table, name, every, checkpoint)
    return table


def touches(readings: DataFrame) -> DataFrame:
    """Newest message time per sensor, and the newest battery level and signal strength that were sent."""
    newest = lambda c: F.max_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col("ts")))
    return readings.groupBy("sensor_id").agg(F.max("ts").alias("last_seen"), newest("battery").alias("battery_pct"), newest("rssi").alias("rssi_dbm"))


def touched(sensors: DataFrame, table: DataFrame) -> DataFrame:
    """The sensor table with the rows of :func:`touches` merged in."""
    t = table.select("sensor_id", F.col("last_seen").alias("_seen"), F.map_filter(
        F.create_map(F.lit("battery_pct"), F.col("battery_pct"), F.lit("rssi_dbm"), F.col("rssi_dbm")), lambda k, v: v.isNotNull()).alias("_meta"))
    j = sensors.join(t, "sensor_id", "left")
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("metadata", none), F.coalesce("_meta", none)
    return j.select("sensor_id", F.greatest("_seen", "last_seen").alias("last_seen"), F.when(F.col("_seen").isNotNull(), "active").otherwise(F.col("status")).alias("status"),
                    F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new).alias("metadata"))


def _run_of(checkpoint: str) -> str:
    return f"r{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}"
