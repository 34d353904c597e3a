"""Sensor messages: parse, validate, flatten, and the row-level helpers of the other tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.timefeat import micros

# fixed values: message path -> field name
RENAMES = {
    "measurements.pm2_5": "pm25", "measurements.pm10": "pm10", "measurements.pm1_0": "pm1_0",
    "measurements.co_ppm": "co", "measurements.no2_ppb": "no2", "measurements.o3_ppb_est": "o3",
    "measurements.nh3_ppm": "nh3_ppm", "measurements.temperature_c": "temperature",
    "measurements.humidity_pct": "humidity", "measurements.pressure_hpa": "pressure",
    "battery.level_pct": "battery_level", "battery.voltage_v": "battery_voltage", "network.rssi_dbm": "rssi",
    "network.buffer_pending": "buffer_pending",
}
# fixed values: reference level of each radar axis
RADAR_REFS = {"pm25": 25, "pm10": 50, "no2": 100, "co": 9, "temperature": 40, "humidity": 100}


def from_rows(m: DataFrame) -> DataFrame:
    """JSON messages (``topic``, ``value``) from flat rows; rows marked ``broken`` get cut text."""
    payload = F.to_json(F.struct(
        "sensor_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "seq", F.lit("2.1").alias("firmware"),
        F.struct(F.col("pm25").alias("pm2_5"), F.col("pm10").alias("pm10"), F.lit(0.5).alias("co_ppm"),
                 F.lit(10.0).alias("no2_ppb"), F.lit(20.0).alias("o3_ppb_est"),
                 F.col("temperature").alias("temperature_c"), F.col("humidity").alias("humidity_pct"),
                 F.lit(1012.0).alias("pressure_hpa")).alias("measurements"),
        F.struct((F.col("user_id") % 101).cast("int").alias("level_pct"), F.lit(3.9).alias("voltage_v")).alias("battery"),
        F.struct(F.lit(-70).alias("rssi_dbm"), F.lit(0).alias("buffer_pending")).alias("network")))
    return m.select("event_id", "ts", F.concat(F.lit("city/sensors/"), F.col("sensor_id"), F.lit("/data")).alias("topic"),
                    F.when(F.col("broken"), F.left(payload, F.length(payload) - 3)).otherwise(payload).alias("value"))


def parse(raw: DataFrame) -> DataFrame:
    """Add ``msg``, null where the text is not valid JSON of the contract."""
    shape = T.StructType([*S.MESSAGE.fields, T.StructField("_corrupt", T.StringType())])
    j = F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # the generator keeps later filters from copying the parse into every one of their terms
    return (raw.select("*", F.explode(F.array(j)).alias("msg"))
            .withColumn("msg", F.when(F.col("msg").isNotNull() & F.col("msg._corrupt").isNull(), F.col("msg"))))


def rules(m: str = "msg") -> dict[str, Column]:
    c = lambda p: F.col(f"{m}.{p}")
    return {
        "sensor_id": c("sensor_id").rlike(S.SENSOR_ID_PATTERN),
        "timestamp": c("timestamp").isNotNull(),
        "seq": c("seq").between(0, S.SEQ_MAX),
        "humidity": c("measurements.humidity_pct").between(*S.HUMIDITY_RANGE),
        "temperature": c("measurements.temperature_c").between(*S.TEMPERATURE_RANGE),
        "pm2_5": c("measurements.pm2_5").isNotNull(),
    }


def validate(parsed: DataFrame) -> DataFrame:
    """Add ``error`` (null, ``json_parse_error`` or ``validation_error``) and the failed rules."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules().items()]))
    d = parsed.withColumn("failed", F.when(F.col("msg").isNotNull(), failed))
    return d.withColumn("error", F.when(F.col("msg").isNull(), "json_parse_error")
                        .when(F.size("failed") > 0, "validation_error"))


def flatten(parsed: DataFrame) -> DataFrame:
    keep = [c for c in parsed.columns if c not in ("msg", "ts", "value", "failed", "error")]
    return parsed.select(*keep, F.col("msg.sensor_id").alias("sensor_id"), F.col("msg.timestamp").alias("ts"),
                         F.col("msg.seq").alias("seq"), F.col("msg.firmware").alias("firmware"),
                         *[F.col(f"msg.{p}").alias(n) for p, n in RENAMES.items()])


def stale(ts: Column, seen_at: Column, limit_s: int = 300) -> Column:
    return F.abs(micros(seen_at) - micros(ts)) > limit_s * 1_000_000


def slug(path: Column) -> Column:
    return F.split_part(path, F.lit("."), F.lit(-1))


def slug_from_serial(serial: Column) -> Column:
    parts = F.split(serial, "-")
    return F.when(F.size(parts) >= 4, F.lower(F.get(parts, F.lit(2)))).otherwise("unknown")


def optional_filter(df: DataFrame, date_col: str | None = None, created_from=None, created_to=None, **equals) -> DataFrame:
    """Keep rows that match every given condition; ``None`` means "any"."""
    for name, v in equals.items():
        if v is not None:
            df = df.where(F.col(name) == v)
    kind = df.schema[date_col].dataType if date_col else None
    if created_from is not None:
        df = df.where(F.col(date_col) >= F.lit(created_from).cast(kind))
    if created_to is not None:
        df = df.where(F.col(date_col) < F.lit(created_to).cast(kind))
    return df


def search_log(log: DataFrame, service=None, level=None, search=None) -> DataFrame:
    d = optional_filter(log, service=service, level=level.upper() if level else None)
    return d.where(F.contains(F.lower("message"), F.lit(search.lower()))) if search else d


def sensor_grid(sensors: DataFrame, zone=None, status=None, min_battery=None, min_rssi=None, needle=None,
                sort: str = "sensor_id", default=0) -> DataFrame:
    d = optional_filter(sensors, zone_id=zone, status=status)
    if min_battery is not None:
        d = d.where(F.coalesce("battery", F.lit(0)) >= min_battery)
    if min_rssi is not None:
        d = d.where(F.coalesce("rssi", F.lit(-200)) >= min_rssi)
    if needle:
        n = F.lit(needle.lower())
        d = d.where(F.contains(F.lower(F.col("sensor_id").cast("string")), n) | F.contains(F.lower("nom"), n))
    return d.orderBy(F.coalesce(sort, F.lit(default)).desc(), "sensor_id")


def to_long(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(fields), "field", "value")


def align(df: DataFrame, keys: Sequence[str], features: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """The given feature list in order; absent columns and nulls take the fill value."""
    f = F.lit(fill).cast("double")
    return df.select(*keys, *[(F.coalesce(c, f) if c in df.columns else f).alias(c) for c in features])


def floor0(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def unit_interval(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def report_rules(text: Column, lat: Column, lon: Column, kind: Column, kinds: Sequence[str]) -> dict[str, Column]:
    return {"text_ok": F.length(F.trim(text)).between(10, 500), "lat_ok": lat.between(14.50, 14.90),
            "lon_ok": lon.between(-17.60, -17.20), "kind_ok": kind.isin(*kinds)}


def with_error(predictions: DataFrame) -> DataFrame:
    e = F.col("predicted_value") - F.col("actual_value")
    return predictions.withColumn("error", e).withColumn("abs_error", F.abs(e))


def radar(wide: DataFrame, key: str) -> DataFrame:
    d = wide.select(key, *[F.coalesce(F.least(F.lit(150.0), F.col(f) / ref * 100), F.lit(0.0)).alias(f)
                           for f, ref in RADAR_REFS.items()])
    return d.unpivot([key], list(RADAR_REFS), "axis", "pct")


def confidence(std: Column, x: Column) -> Column:
    return F.round(unit_interval(1 - std / F.greatest(x, F.lit(1.0))), 3)
