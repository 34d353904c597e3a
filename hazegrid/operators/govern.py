"""Audit, erasure, retention and alert state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import polygons
from .joins import in_zone_box, locate

# fixed values: columns whose change is not audited, and the replacement text
UNAUDITED = ("created_at", "updated_at", "last_seen", "last_active")
ERASED_TEXT = "[SUPPRIMÉ RGPD]"


def changed_keys(old: Column, new: Column, ignore: Sequence[str] = UNAUDITED) -> Column:
    """Keys present in both maps whose values differ, sorted."""
    diff = F.filter(F.map_keys(new), lambda k: F.map_contains_key(old, k) & ~F.element_at(new, k).eqNullSafe(F.element_at(old, k))
                    & ~k.isin(*ignore))
    return F.array_sort(diff)


def image(df: DataFrame, key: str) -> DataFrame:
    pairs = [x for c in df.columns if c != key for x in (F.lit(c), F.col(c).cast("string"))]
    return df.select(F.col(key), F.create_map(*pairs).alias("image"))


def audit_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """INSERT, UPDATE and DELETE rows between two snapshots, with the changed columns."""
    o, n = image(old, key).withColumnRenamed("image", "old"), image(new, key).withColumnRenamed("image", "new")
    j = o.join(n, key, "full_outer")
    same = F.size(changed_keys(F.col("old"), F.col("new"), ())) == 0
    action = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").when(~same, "UPDATE")
    return j.select(key, action.alias("action"), F.when(action == "UPDATE", changed_keys(F.col("old"), F.col("new"))).alias("changed"),
                    "old", "new").where(F.col("action").isNotNull())


def erase(citizens: DataFrame, reports: DataFrame, users: DataFrame, requested: DataFrame, now: Column):
    """The three tables after erasing the requested users, and (action, affected_rows)."""
    hit_users = users.join(requested.select(F.col("user_id").alias("_u")).distinct(), F.col("id") == F.col("_u"), "left")
    gone = hit_users.where(F.col("_u").isNotNull() & F.col("citizen_id").isNotNull()).select(
        F.col("citizen_id").alias("_c")).distinct()
    hit = F.col("_c").isNotNull()
    c = citizens.join(gone, F.col("id") == F.col("_c"), "left")
    new_c = c.select("id", F.when(hit, F.concat(F.lit("anonyme_"), F.left(F.sha2(F.concat(F.lit("erased:"), F.col("id").cast("string")), 256), F.lit(8))))
                     .otherwise(F.col("pseudonyme")).alias("pseudonyme"),
                     F.when(hit, F.lit(False)).otherwise(F.col("data_consent")).alias("data_consent"),
                     F.when(hit, now).alias("erasure_completed_at"), hit.alias("erased"))
    r = reports.join(gone, F.col("citizen_id") == F.col("_c"), "left")
    new_r = r.select("report_id", "citizen_id", F.when(hit, ERASED_TEXT).otherwise(F.col("texte")).alias("texte"), hit.alias("erased"))
    uh = F.col("_u").isNotNull()
    new_u = hit_users.select("id", F.when(uh, F.concat(F.lit("erased_"), F.left(F.sha2(F.col("id").cast("string"), 256), F.lit(16))))
                             .otherwise(F.col("email")).alias("email"), (F.col("is_active") & ~uh).alias("is_active"),
                             F.when(~uh, F.col("citizen_id")).alias("citizen_id"), uh.alias("erased"))
    n = lambda d, a: d.agg(F.count_if("erased").alias("affected_rows")).select(F.lit(a).alias("action"), "affected_rows")
    counts = (n(new_c, "citizens_anonymized").unionByName(n(new_r, "reports_anonymized"))
              .unionByName(n(new_u, "users_anonymized")).unionByName(n(new_u, "audit_logged")))
    return new_c, new_r, new_u, counts


def update_from(target: DataFrame, changes: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Rows with a change take the new non-null values."""
    c = changes.select(key, *[F.col(x).alias(f"_n_{x}") for x in cols])
    j = target.join(c, key, "left")
    return j.withColumns({x: F.coalesce(f"_n_{x}", x) for x in cols}).drop(*[f"_n_{x}" for x in cols])


def alert_state(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts after acknowledge, resolve and dismiss actions (``alert_id``, ``action``, ``at``).

    Acknowledging sends an alert and dismissing cancels it, so the later of the two decides; resolving
    cancels only an alert that is still pending. ``sent_at`` is the first acknowledgement.
    """
    at = lambda a, f: f(F.when(F.col("action") == a, F.col("at")))
    s = actions.groupBy("alert_id").agg(
        at("acknowledge", F.max).alias("acknowledged_at"), at("acknowledge", F.min).alias("sent_at"),
        at("resolve", F.max).alias("resolved_at"),
        F.max_by("action", F.when(F.col("action") != "resolve", F.col("at"))).alias("_last"))
    j = alerts.join(s, alerts["id"] == s["alert_id"], "left").drop("alert_id")
    after = (F.when(F.col("_last") == "acknowledge", "sent").when(F.col("_last") == "dismiss", "cancelled")
             .when(F.col("resolved_at").isNotNull() & (F.col("statut_envoi") == "pending"), "cancelled")
             .otherwise(F.col("statut_envoi")))
    return j.withColumn("statut_envoi", after).drop("_last")


def resolved_anomalies(anomalies: DataFrame, alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Anomalies after the actions: those whose alert was resolved are handled."""
    done = actions.where(F.col("action") == "resolve").select("alert_id").distinct()
    hit = alerts.join(done, alerts["id"] == done["alert_id"]).where(F.col("anomaly_id").isNotNull()).select(F.col("anomaly_id").alias("_a")).distinct()
    j = anomalies.join(hit, F.col("id") == F.col("_a"), "left")
    return j.withColumn("handled", F.coalesce("handled", F.lit(False)) | F.col("_a").isNotNull()).drop("_a")


def update_consent(users: DataFrame, citizens: DataFrame, requests: DataFrame):
    """Users, their citizens and audit rows after consent ``requests(user_id, data_consent, retention_days, at)``.

    A user's latest request counts (of several at one time the one that withdraws). The date of consent moves only when consent is given.
    """
    r = requests.groupBy(F.col("user_id").alias("_u")).agg(F.max_by(F.struct("data_consent", "retention_days"), F.struct("at", ~F.col("data_consent"))).alias("_r"),
                                                          F.max(F.when(F.col("data_consent"), F.col("at"))).alias("_given"))
    u = users.join(r, F.col("id") == F.col("_u"), "left")
    new_u = u.withColumns({"data_consent": F.coalesce("_r.data_consent", "data_consent"), "data_retention_days": F.coalesce("_r.retention_days", "data_retention_days"),
                           "consent_date": F.coalesce("_given", "consent_date")}).select(*users.columns)
    c = u.where(F.col("_u").isNotNull() & F.col("citizen_id").isNotNull()).groupBy(F.col("citizen_id").alias("_c")).agg(F.min("_r.data_consent").alias("_v"))
    new_c = citizens.join(c, F.col("id") == F.col("_c"), "left").withColumn("data_consent", F.coalesce("_v", "data_consent")).select(*citizens.columns)
    withdrawn = requests.where(~F.col("data_consent")).select(F.lit("UPDATE").alias("action"), F.lit("users").alias("resource"), F.col("user_id").cast("string").alias("resource_id"),
                                                              F.col("at").alias("timestamp"), F.to_json(F.struct(F.lit(True).alias("consent_withdrawn"), "retention_days")).alias("details"))
    return new_u, new_c, withdrawn


def acknowledge_all(alerts: DataFrame, now: Column, severity: str | None = None) -> DataFrame:
    """Actions that acknowledge every pending alert, or those of one severity."""
    d = alerts.where(F.col("statut_envoi") == "pending")
    d = d.where(F.col("gravite") == severity) if severity else d
    return d.select(F.col("id").alias("alert_id"), F.lit("acknowledge").alias("action"), now.alias("at"))


def published_positions(located: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    """``(key, p)``: the first shifted position in the row's own polygon zone, the last one if none is; any will do without a zone."""
    tries = located.select(F.col(key).alias("_key"), F.col("zone_id").alias("_zone"), F.posexplode(geo.shifted(F.col("lon"), F.col("lat"), F.col(key))).alias("_try", "_p"))
    tries = polygons.containing(tries.select("_key", "_zone", "_try", "_p.lon", "_p.lat"), zones)
    ok = F.col("_zone").isNull() | F.coalesce(F.exists("zones", lambda z: z["zone_id"] == F.col("_zone")), F.lit(False))
    best = F.min(F.struct((~ok).alias("no"), F.when(ok, F.col("_try")).otherwise(-F.col("_try")).alias("n"), "lon", "lat"))
    return tries.groupBy("_key").agg(best.alias("p"))


def intake(submitted: DataFrame, zones: DataFrame, citizens: DataFrame):
    """New reports with zone and published position, and the citizens' updated counters.

    Zones are squares, or polygons if they have a column ``rings``.
    """
    p = locate(submitted, zones)
    if "rings" in zones.columns:
        at = published_positions(p, zones.where(F.col("niveau") == 3), "report_id")
        p = p.join(at, F.col("report_id") == F.col("_key"))
    else:
        p = p.join(zones.select("zone_id", "lon_c", "lat_c", "half"), "zone_id", "left")
        box = F.struct("lon_c", "lat_c", "half")
        p = p.withColumn("p", geo.anonymize_point(F.col("lon"), F.col("lat"), F.col("report_id"),
                                                  lambda x, y: F.col("lon_c").isNull() | in_zone_box(box, x, y)))
    reports = p.select("report_id", "citizen_id", "zone_id", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), F.lit("pending").alias("nlp_status"))
    added = submitted.groupBy("citizen_id").agg(F.count("*").alias("_n"))
    merged = citizens.select("citizen_id", "reports_count").join(added, "citizen_id", "full_outer").select(
        "citizen_id", (F.coalesce("reports_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("reports_count"))
    return reports, merged
