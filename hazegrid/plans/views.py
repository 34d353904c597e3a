"""Stand-in views: the domain tables as seen through the given test tables.

The SQL text of each view is valid in Spark and in DuckDB, so that a query and its check start
from the same rows. Jobs on real data pass their own tables to the operator functions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"
BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()

# fixed values: tokens that occur in the invented prose, standing in for the French keyword lists
POLLUTANT_TOKENS = ["the", "para", "und", "pour", "que", "der", "los"]
URGENT_TOKENS = ["worthless", "zwischen", "mentaient", "ciones de", "ereth"]

_FIELD = ("CASE event_type WHEN 'click' THEN 'pm25' WHEN 'view' THEN 'pm10' WHEN 'purchase' THEN 'co' "
          "WHEN 'signup' THEN 'no2' ELSE 'o3' END")
_VALUE = ("CASE WHEN event_type = 'purchase' THEN value / 10 WHEN event_type = 'view' THEN value * 1.6 "
          "ELSE value END")
_HORIZON = "(CASE event_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 360 ELSE 1440 END)"

VIEW_SQL = {
    "v_readings": f"""SELECT event_id AS reading_id, ts, user_id AS sensor_id, user_id % 25 AS zone_id,
  {_FIELD} AS field, {_VALUE} AS value, (event_id * 7919) % 1000 AS seq FROM events""",
    "v_zones": """SELECT CAST(n_nationkey AS BIGINT) AS zone_id, n_name AS nom,
  'root.r' || CAST(n_regionkey AS VARCHAR(9)) || '.n' || CAST(n_nationkey AS VARCHAR(9)) AS path, 3 AS niveau,
  CAST(-17.55 + 0.05 * (n_nationkey % 5) AS DOUBLE) AS lon_c,
  CAST(14.62 + 0.04 * floor(n_nationkey / 5) AS DOUBLE) AS lat_c, CAST(0.015 AS DOUBLE) AS half FROM nation""",
    # stars of twelve corners that overlap their neighbours, every third with a hole, and a city with a hole around them all
    "v_zone_vertices": """SELECT z AS zone_id, 3 AS niveau, 0 AS ring, k, round(cx + r * (1 - 0.45E0 * (k % 2)) * cos(pi() * k / 6), 6) AS lon,
  round(cy + r * (1 - 0.45E0 * (k % 2)) * sin(pi() * k / 6), 6) AS lat FROM (SELECT CAST(n_nationkey AS BIGINT) AS z, -17.55E0 + 0.05E0 * (n_nationkey % 5) AS cx,
  14.62E0 + 0.04E0 * floor(n_nationkey / 5) AS cy, 0.03E0 + 0.0007E0 * n_nationkey AS r FROM nation) n
  CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) v(k)
  UNION ALL SELECT CAST(n_nationkey AS BIGINT), 3, 1, k, round(-17.55E0 + 0.05E0 * (n_nationkey % 5) + 0.009E0 * cos(pi() * k / 2), 6),
  round(14.62E0 + 0.04E0 * floor(n_nationkey / 5) + 0.009E0 * sin(pi() * k / 2), 6) FROM nation CROSS JOIN (VALUES (0), (1), (2), (3)) v(k) WHERE n_nationkey % 3 = 0
  UNION ALL SELECT CAST(100 AS BIGINT), 1, ring, k, round(-17.45E0 + (0.12E0 - 0.09E0 * ring) * cos(pi() * k / 6), 6), round(14.70E0 + (0.12E0 - 0.09E0 * ring) * sin(pi() * k / 6), 6)
  FROM region CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) v(k) CROSS JOIN (VALUES (0), (1)) w(ring) WHERE r_regionkey = 0""",
    "v_sensors": """SELECT sensor_id, sensor_id % 25 AS zone_id,
  CASE WHEN sensor_id % 10 = 0 THEN 'inactive' ELSE 'active' END AS status, last_seen
  FROM (SELECT user_id AS sensor_id, max(ts) AS last_seen FROM events GROUP BY user_id) t""",
    "v_weather": """SELECT user_id % 25 AS zone_id, ts, event_id, CAST(20 + event_id % 20 AS DOUBLE) AS temperature,
  CAST(40 + event_id % 50 AS DOUBLE) AS humidity, CAST(1000 + event_id % 30 AS DOUBLE) AS pressure,
  value / 20 AS wind_speed, CAST((event_id * 37) % 360 AS DOUBLE) AS wind_direction,
  CAST(event_id % 7 AS DOUBLE) AS precipitation FROM events WHERE event_type = 'view'""",
    "v_traffic": """SELECT user_id % 25 AS zone_id, ts, event_id, event_id % 101 AS congestion_level
  FROM events WHERE event_type = 'purchase'""",
    "v_predictions": f"""SELECT event_id AS prediction_id, user_id % 25 AS zone_id, ts AS created_at,
  value AS predicted_value, {_HORIZON} AS horizon_minutes,
  ts + INTERVAL '1' MINUTE * {_HORIZON} AS target_timestamp FROM events WHERE event_type = 'signup'""",
    "v_calibration": """SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS sensor_id, l_shipdate AS valid_from,
  0.5 + l_discount * 10 AS coef_a, l_tax * 10 AS coef_b, 1 - l_quantity / 50 AS r2_score,
  CASE l_returnflag WHEN 'A' THEN 'pm25' WHEN 'N' THEN 'pm10' ELSE 'no2' END AS pollutant FROM lineitem""",
    "v_alerts": """SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS zone_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS statut_envoi,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'danger' WHEN '3' THEN 'warning'
  ELSE 'info' END AS gravite FROM orders JOIN customer ON c_custkey = o_custkey""",
    "v_reports": """SELECT doc_id AS report_id, text AS texte, lang AS langue, source AS source_app,
  (doc_id * 37) % 43200 AS minute_of_month,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST((doc_id * 37) % 43200 AS INT) AS created_at,
  CASE WHEN (doc_id * 37) % 3 = 0 THEN 'done' ELSE 'pending' END AS nlp_status,
  CAST(-17.57 + 0.0001 * ((doc_id * 7919) % 2400) AS DOUBLE) AS lon,
  CAST(14.60 + 0.0001 * ((doc_id * 104729) % 2200) AS DOUBLE) AS lat FROM documents""",
    "v_anomalies": f"""SELECT event_id AS id, user_id AS sensor_id, user_id % 25 AS zone_id, {_FIELD} AS pollutant,
  {_VALUE} AS detected_value, CAST((event_id * 31) % 1000 AS DOUBLE) / 1000 AS anomaly_score, ts AS detected_at,
  (event_id * 13) % 240 AS duration_minutes, event_id % 4 = 0 AS handled FROM events WHERE value >= 40""",
    "v_anomaly_alerts": """SELECT event_id * 10 AS id, event_id AS anomaly_id, user_id % 25 AS zone_id,
  'pollution' AS type, CASE WHEN value >= 120 THEN 'danger' ELSE 'warning' END AS gravite,
  'value above limit' AS message, ts AS created_at FROM events WHERE value >= 70""",
    "v_models": """SELECT p_partkey AS id, p_brand AS name, p_type AS type, CAST(p_partkey AS VARCHAR(12)) AS version,
  p_retailprice AS rmse, p_size % 2 = 0 AS is_active,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE TIMESTAMP '2024-01-31 00:00:00'
  - INTERVAL '1' MINUTE * CAST((p_partkey * 53) % 40000 AS INT) END AS training_end FROM part""",
    "v_features": """SELECT user_id % 25 AS zone_id, date_trunc('hour', ts) AS ts,
  avg(CASE WHEN event_type = 'click' THEN value END) AS pm25_rolling_mean_1h,
  avg(CASE WHEN event_type = 'view' THEN value * 1.6 END) AS pm10_rolling_mean_1h,
  avg(CASE WHEN event_type = 'signup' THEN value END) AS no2_lag_1h,
  CAST(count(*) AS DOUBLE) AS n_points FROM events GROUP BY user_id % 25, date_trunc('hour', ts)""",
    "v_log": """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'ingestion' WHEN 'view' THEN 'calibration'
  WHEN 'purchase' THEN 'alerts' WHEN 'signup' THEN 'monitoring' ELSE 'anomaly_detector' END AS service,
  CASE WHEN event_id % 17 = 0 THEN 'ERROR' WHEN event_id % 5 = 0 THEN 'WARN' ELSE 'INFO' END AS level,
  'Value of sensor ' || CAST(user_id AS VARCHAR(12)) || ' is ' || event_type AS message, props AS metadata,
  ts AS created_at FROM events""",
    "v_metrics": """SELECT event_id AS id, ts AS computed_at, value / 100 AS q1_coverage, props AS metrics
  FROM events WHERE event_type = 'signup'""",
    "v_entities": "SELECT doc_id AS report_id, 'POLLUTANT' AS entity_type, kw AS entity_value FROM ("
                  + " UNION ALL ".join(
                      f"SELECT doc_id, '{k}' AS kw FROM documents WHERE lower(text) LIKE '%{k}%'"
                      for k in POLLUTANT_TOKENS) + ") e",
    "v_messages": """SELECT event_id, ts,
  CASE WHEN event_id % 23 = 0 THEN 'BAD-' ELSE 'ESP32-DK-' END || upper(event_type) || '-'
  || right('00' || CAST(user_id % 1000 AS VARCHAR(9)), 3) AS sensor_id,
  CASE WHEN event_id % 41 = 0 THEN -1 ELSE (event_id * 7919) % 100000 END AS seq,
  CASE WHEN event_id % 19 = 0 THEN 140.0E0 ELSE CAST(event_id % 101 AS DOUBLE) END AS humidity,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(event_id % 75 - 12 AS DOUBLE) END AS temperature,
  event_id % 37 = 0 AS broken, value AS pm25, value * 1.6 AS pm10, user_id FROM events""",
    # the same events packed into the last four hours, so that a look-back of two hours has rows of every sensor; every fourth sensor hangs
    "v_dense": """SELECT event_id * 2 AS reading_id, TIMESTAMP '2024-01-30 20:00:00' + INTERVAL '1' SECOND * CAST((event_id * 37) % 14400 AS INT) AS ts, user_id AS sensor_id, user_id % 25 AS zone_id,
  'pm25' AS field, CASE WHEN user_id % 4 = 1 THEN 20 + value / 10000 ELSE value END AS value FROM events UNION ALL
  SELECT event_id * 2 + 1, TIMESTAMP '2024-01-30 20:00:00' + INTERVAL '1' SECOND * CAST((event_id * 37) % 14400 AS INT), user_id, user_id % 25, 'pm10', value * (0.5E0 + (event_id % 10) * 0.15E0) FROM events""",
    "v_citizens": """SELECT c_custkey AS id, c_name AS pseudonyme, c_nationkey AS zone_id, c_mktsegment AS segment,
  c_acctbal AS balance, c_acctbal >= 0 AS data_consent, 30 + c_custkey % 700 AS retention_days FROM customer""",
}
_BASE_RE = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(BASE) + r")\b")


class Tables:
    """Base tables and stand-in views of one data folder, read lazily by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEW_SQL:
            return self.spark.sql(_BASE_RE.sub(
                lambda m: f"{m.group(1)} parquet.`{self.sf_dir}/{m.group(2)}.parquet`", VIEW_SQL[name]))
        raise AttributeError(name)


def now():
    return F.lit(NOW).cast("timestamp_ntz")
