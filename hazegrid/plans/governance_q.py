"""Audit, erasure, retention, alert state and report intake."""

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import govern
from ..operators.supervise import attach, hours
from ..session import shared_dir
from .joins_q import EDGE_SQL, HIT_SQL, zone_polygons
from .registry import query
from .views import now


def snapshots(t):
    """Two states of the citizens: edited balances and segments, rows gone, rows new."""
    c = t.v_citizens.select("id", "pseudonyme", "zone_id", "segment", "balance")
    old = c.where(F.col("zone_id") != 3)
    new = c.where(F.col("zone_id") != 5).withColumn("balance", F.when(F.col("zone_id") == 7, F.col("balance") + 1).otherwise(F.col("balance")))
    return old, new.withColumn("segment", F.when(F.col("zone_id").isin(7, 9), F.lower("segment")).otherwise(F.col("segment")))


@query("gov_audit_diff", """SELECT id, CASE WHEN zone_id=3 THEN 'INSERT' WHEN zone_id=5 THEN 'DELETE' ELSE 'UPDATE' END AS action, CASE zone_id WHEN 7 THEN 'balance,segment' WHEN 9 THEN 'segment' END AS changed FROM v_citizens WHERE zone_id IN (3,5,7,9)""")
def _(t):
    old, new = snapshots(t)
    return govern.audit_diff(old, new, "id").select("id", "action", F.array_join("changed", ",").alias("changed"))


@query("gov_audit_query", "SELECT strftime(created_at,'%Y-%m') AS month, service AS resource, count(*) AS n FROM v_log WHERE level='WARN' GROUP BY 1,2")
def _(t):
    path = shared_dir(t.spark, "audit")
    log = t.v_log.select(F.col("created_at").alias("timestamp"), F.lit("READ").alias("action"), F.col("service").alias("resource"),
                         F.col("metadata").alias("details"), F.when(F.col("level") == "WARN", "denied").otherwise("success").alias("status"),
                         F.date_format("created_at", "yyyy-MM").alias("month"))
    log.write.mode("append").partitionBy("month").parquet(path)
    return (t.spark.read.schema(log.schema).parquet(path).where(F.col("status") == "denied").groupBy("month", "resource")
            .agg(F.count("*").alias("n")))


@query("gov_erase", """SELECT 'citizens_anonymized' AS action, count(*) FILTER (zone_id=4) AS affected_rows FROM v_citizens UNION ALL SELECT 'reports_anonymized', (SELECT count(*) FROM v_reports WHERE report_id % (SELECT count(*) FROM v_citizens) IN (SELECT id FROM v_citizens WHERE zone_id=4))
UNION ALL SELECT 'users_anonymized', count(*) FILTER (zone_id=4) FROM v_citizens UNION ALL SELECT 'audit_logged', count(*) FILTER (zone_id=4) FROM v_citizens""")
def _(t):
    c = t.v_citizens
    n = c.agg(F.count("*").alias("_n"))
    r = attach(t.v_reports, n).select("report_id", (F.col("report_id") % F.col("_n")).alias("citizen_id"), "texte")
    users = c.select("id", F.col("id").alias("citizen_id"), F.concat("pseudonyme", F.lit("@example.org")).alias("email"), F.lit(True).alias("is_active"))
    asked = c.where(F.col("zone_id") == 4).select(F.col("id").alias("user_id"))
    return govern.erase(c, r, users, asked, now())[3]


@query("gov_retention_user", """SELECT r.reading_id, c.id AS citizen_id FROM v_readings r JOIN v_citizens c ON c.id=r.sensor_id WHERE c.retention_days BETWEEN 30 AND 3650 AND r.ts >= $NOW - INTERVAL 1 DAY * (c.retention_days - 25)""")
def _(t):
    c = t.v_citizens.where(F.col("retention_days").between(30, 3650)).select(F.col("id").alias("citizen_id"), (F.col("retention_days") - 25).cast("int").alias("d"))
    j = t.v_readings.join(c, F.col("sensor_id") == F.col("citizen_id"))
    return j.where(F.col("ts") >= now() - F.make_dt_interval(F.col("d"))).select("reading_id", "citizen_id")


@query("gov_alert_lifecycle", """SELECT id, CASE WHEN id % 5 = 0 AND statut_envoi='pending' THEN 'cancelled' WHEN id % 5 <> 0 AND statut_envoi='pending' AND gravite='danger' THEN 'sent' ELSE statut_envoi END AS statut_envoi,
 CASE WHEN statut_envoi='pending' AND gravite='danger' THEN created_at + INTERVAL 2 HOUR END AS acknowledged_at, CASE WHEN id % 5 = 0 THEN created_at + INTERVAL 3 HOUR END AS resolved_at FROM (SELECT *, statut_envoi AS s FROM v_alerts) WHERE NOT (id % 5 = 0 AND statut_envoi='pending' AND gravite='danger')
UNION ALL SELECT id, 'sent', created_at + INTERVAL 2 HOUR, created_at + INTERVAL 3 HOUR FROM v_alerts WHERE id % 5 = 0 AND statut_envoi='pending' AND gravite='danger'""")
def _(t):
    a = t.v_alerts
    ack = govern.acknowledge_all(a, F.col("created_at") + hours(2), "danger")
    res = a.where(F.col("id") % 5 == 0).select(F.col("id").alias("alert_id"), F.lit("resolve").alias("action"), (F.col("created_at") + hours(3)).alias("at"))
    return govern.alert_state(a, ack.unionByName(res)).select("id", "statut_envoi", "acknowledged_at", "resolved_at")


#: Positions are shifted by a hash that SQL does not have: checked is that the shift stays within its bound.
@query("gov_report_intake", f"""WITH {EDGE_SQL}, h AS ({HIT_SQL.format(p='v_reports')}), s AS (SELECT report_id, report_id % (SELECT count(*) + 10 FROM v_citizens) AS citizen_id FROM v_reports),
n AS (SELECT citizen_id, count(*) AS n FROM s GROUP BY 1), z AS (SELECT report_id, arg_min(zone_id, area) AS zone_id FROM h JOIN ar USING (zone_id) WHERE niveau=3 GROUP BY 1)
SELECT s.report_id, s.citizen_id, z.zone_id, n + CASE WHEN c.id IS NULL THEN 0 ELSE 1 END AS reports_count, 'pending' AS nlp_status, true AS shift_bounded FROM s LEFT JOIN z USING (report_id) JOIN n USING (citizen_id) LEFT JOIN v_citizens c ON c.id=s.citizen_id""")
def _(t):
    c = t.v_citizens.select(F.col("id").alias("citizen_id"), F.lit(1).cast("long").alias("reports_count"))
    n = c.agg((F.count("*") + 10).alias("_n"))
    sub = attach(t.v_reports, n).select("report_id", (F.col("report_id") % F.col("_n")).alias("citizen_id"), "lon", "lat")
    published, counters = govern.intake(sub, zone_polygons(t), c)
    given = t.v_reports.select("report_id", F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    off = F.greatest(F.abs(F.col("lon") - geo.snap(F.col("_x"), 0.001)), F.abs(F.col("lat") - geo.snap(F.col("_y"), 0.001)))
    return published.join(counters, "citizen_id").join(given, "report_id").select(
        "report_id", "citizen_id", "zone_id", "reports_count", "nlp_status", (off <= 0.0005 + 1e-9).alias("shift_bounded"))


@query("gov_active_views", """WITH n AS (SELECT max(created_at) AS m FROM v_alerts) SELECT 'alerts_24h' AS view_name, CAST(id AS VARCHAR) AS key FROM v_alerts, n WHERE created_at > m - INTERVAL 24 HOUR AND statut_envoi IN ('pending','sent')
UNION ALL SELECT 'active_sensor', CAST(sensor_id AS VARCHAR) FROM v_sensors WHERE status='active' UNION ALL SELECT 'newest', CAST(id AS VARCHAR) FROM (SELECT id FROM v_alerts ORDER BY created_at DESC, id LIMIT 5)""")
def _(t):
    a = t.v_alerts
    m = a.agg(F.max("created_at").alias("_m"))
    day = a.where(F.col("created_at") > m.scalar() - hours(24)).where(F.col("statut_envoi").isin("pending", "sent"))
    v = lambda d, n, k: d.select(F.lit(n).alias("view_name"), F.col(k).cast("string").alias("key"))
    return (v(day, "alerts_24h", "id").unionByName(v(t.v_sensors.where(F.col("status") == "active"), "active_sensor", "sensor_id"))
            .unionByName(v(a.orderBy(F.desc("created_at"), "id").limit(5), "newest", "id")))


@query("gov_alert_resolve", "SELECT id, handled OR id IN (SELECT anomaly_id FROM v_anomaly_alerts WHERE id % 3 = 0) AS handled FROM v_anomalies")
def _(t):
    a = t.v_anomaly_alerts
    act = a.where(F.col("id") % 3 != 1).select(F.col("id").alias("alert_id"), F.when(F.col("id") % 3 == 0, "resolve").otherwise("acknowledge").alias("action"), F.col("created_at").alias("at"))
    return govern.resolved_anomalies(t.v_anomalies, a, act).select("id", "handled")


#: Every second citizen asks twice: gives consent, and every fourth then withdraws it.
@query("gov_consent", """SELECT 'user' AS kind, id, CASE WHEN id%4=0 THEN false WHEN id%2=0 THEN true ELSE data_consent END AS data_consent, CASE WHEN id%4=0 THEN 30 WHEN id%2=0 THEN 365 ELSE retention_days END AS retention_days, CASE WHEN id%2=0 THEN $NOW END AS consent_date FROM v_citizens
UNION ALL SELECT 'citizen', id, CASE WHEN id%4=0 THEN false WHEN id%2=0 THEN true ELSE data_consent END, NULL, NULL FROM v_citizens UNION ALL SELECT 'audit', id, NULL, 30, NULL FROM v_citizens WHERE id%4=0""")
def _(t):
    c = t.v_citizens
    users = c.select("id", F.col("id").alias("citizen_id"), "data_consent", F.col("retention_days").alias("data_retention_days"), F.lit(None).cast("timestamp_ntz").alias("consent_date"))
    ask = lambda w, v, days, at: c.where(w).select(F.col("id").alias("user_id"), F.lit(v).alias("data_consent"), F.lit(days).cast("bigint").alias("retention_days"), at.alias("at"))
    asked = ask(F.col("id") % 2 == 0, True, 365, now()).unionByName(ask(F.col("id") % 4 == 0, False, 30, now() + hours(1)))
    u, ci, audit = govern.update_consent(users, c.select("id", "data_consent"), asked)
    none = lambda k: F.lit(None).cast(k)
    return (u.select(F.lit("user").alias("kind"), "id", "data_consent", F.col("data_retention_days").cast("bigint").alias("retention_days"), "consent_date")
            .unionByName(ci.select(F.lit("citizen").alias("kind"), "id", "data_consent", none("bigint").alias("retention_days"), none("timestamp_ntz").alias("consent_date")))
            .unionByName(audit.select(F.lit("audit").alias("kind"), F.col("resource_id").cast("bigint").alias("id"), none("boolean").alias("data_consent"),
                                      F.get_json_object("details", "$.retention_days").cast("bigint").alias("retention_days"), none("timestamp_ntz").alias("consent_date"))))
