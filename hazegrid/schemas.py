"""Fixed schemas of the message contract and allowed values; no job infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

_d, _i, _l, _s, _b, _ts = T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType(), T.TimestampType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MESSAGE = struct(
    sensor_id=_s, timestamp=_ts, seq=_l, firmware=_s,
    measurements=struct(pm1_0=_d, pm2_5=_d, pm10=_d, co_ppm=_d, no2_ppb=_d, o3_ppb_est=_d, nh3_ppm=_d,
                        temperature_c=_d, humidity_pct=_d, pressure_hpa=_d, warm_up=_b),
    data_quality=struct(humidity_correction_applied=_b, warming_up=_b, calibration_age_days=_d, confidence_score=_d),
    battery=struct(voltage_v=_d, level_pct=_i, charging=_b, solar_active=_b),
    network=struct(type=_s, rssi_dbm=_i, reconnects=_i, buffer_pending=_i),
    position=struct(lat=_d, lon=_d, source=_s), sim=_b,
    sim_metadata=struct(run_id=_s, true_pm25=_d, anomaly_active=_b, anomaly_type=_s))

READINGS_LONG = struct(ts=_ts, sensor_id=_s, zone_id=_l, field=_s, value=_d)
CALIBRATION_CSV = struct(timestamp=_ts, temperature=_d, humidity=_d, pressure=_d, pm25_raw=_d, pm25_true=_d, hour=_i)
SERIES_CSV = struct(ds=_ts, y=_d)

# fixed values: enumerations of the relational tables
ALLOWED = {
    "sensor_status": ("active", "inactive", "maintenance", "decommissioned"),
    "alert_gravite": ("info", "warning", "danger", "critical"),
    "alert_status": ("pending", "sent", "cancelled"),
}
# fixed values: identifier format and ranges of the message contract
SENSOR_ID_PATTERN = r"^ESP32-DK-[A-Z]+-\d{3}$"
HUMIDITY_RANGE, TEMPERATURE_RANGE, SEQ_MAX = (0, 100), (-10, 60), 2**31 - 1
