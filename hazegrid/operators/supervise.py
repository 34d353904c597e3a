"""Paging, feeds, and supervision reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefeat import health, seconds_between
from .messages import slug


def hours(n) -> Column:
    return F.expr(f"INTERVAL '{n}' HOUR")


def minutes(n) -> Column:
    return F.expr(f"INTERVAL '{n}' MINUTE")


def attach(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame (a global aggregate) to every row, as scalar subqueries."""
    return df.select("*", *[one.select(c).scalar().alias(c) for c in one.columns])


def page(df: DataFrame, date_col: str, id_col: str, page: int, size: int) -> DataFrame:
    """One page, newest first, with the total and the number of pages."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(F.col(date_col).desc(), id_col).offset((page - 1) * size).limit(size)
    pages = F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long")
    return attach(rows, total).withColumn("pages", pages)


def recent_series(df: DataFrame, ts: str, id_col: str, n: int) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(n).orderBy(ts, id_col)


def event_feed(anomalies: DataFrame, alerts: DataFrame, metrics: DataFrame, zones: DataFrame, now: Column,
               limit: int, offset: int = 0) -> DataFrame:
    """Anomalies, alerts and quality rows of the last day as one feed, newest first, with the total."""
    z = zones.select("zone_id", slug(F.col("path")).alias("zone"))
    a = anomalies.where(F.col("detected_at") > now - hours(24)).join(z, "zone_id").select(
        F.lit("anomaly_detector").alias("service"), F.lit("WARN").alias("level"),
        F.format_string("Anomaly: %s = %s in zone %s", "pollutant",
                        F.round("detected_value", 2).cast("decimal(12,2)").cast("string"), "zone").alias("message"),
        F.to_json(F.struct(F.col("id").alias("anomaly_id"))).alias("metadata"),
        F.col("detected_at").alias("created_at"), F.lit(1).alias("kind"), "id")
    b = alerts.where(F.col("created_at") > now - hours(24)).join(z, "zone_id").select(
        F.lit("alerts").alias("service"), F.lit("INFO").alias("level"),
        F.format_string("Alert: %s [%s] — %s", "gravite", "type", "message").alias("message"),
        F.to_json(F.struct(F.col("id").alias("alert_id"))).alias("metadata"), "created_at", F.lit(2).alias("kind"), "id")
    m = metrics.where(F.col("computed_at") > now - hours(24)).select(
        F.lit("monitoring").alias("service"), F.lit("INFO").alias("level"),
        F.concat(F.lit("Quality check: "), "metrics").alias("message"), F.col("metrics").alias("metadata"),
        F.col("computed_at").alias("created_at"), F.lit(3).alias("kind"), "id")
    feed = a.unionByName(b).unionByName(m)
    rows = feed.orderBy(F.col("created_at").desc(), "kind", "id").offset(offset).limit(limit)
    return attach(rows, feed.agg(F.count("*").alias("total"))).drop("kind", "id")


def concat_sources(frames: dict[str, DataFrame], pressure: float = 1013.0, hour: int = 12) -> DataFrame:
    """Training frames one after another with a source tag; missing columns take defaults."""
    out = None
    for name, f in frames.items():
        f = f.withColumn("source", F.lit(name))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    cols = out.columns
    h = F.coalesce(F.hour("timestamp"), F.lit(hour)) if "timestamp" in cols else F.lit(hour)
    p = F.coalesce("pressure", F.lit(pressure)) if "pressure" in cols else F.lit(pressure)
    return out.withColumn("hour", h).withColumn("pressure", p)


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Side by side: frames that hold one row each (global aggregates)."""
    return parts[0].sparkSession.range(1).select(*[p.select(c).scalar().alias(c) for p in parts for c in p.columns])


def flow_health(last_runs: dict[str, tuple[DataFrame, str, float, float]], now: Column) -> DataFrame:
    """Age of the newest row per job and ok/warn/stale by the job's limits in minutes."""
    out = None
    for name, (df, ts, warn, crit) in last_runs.items():
        d = df.agg(F.max(ts).alias("last_run"))
        age = F.round(seconds_between(now, F.col("last_run")) / 60, 1)
        d = d.select(F.lit(name).alias("flow"), "last_run", age.alias("age_min"), health(age, warn, crit).alias("health"))
        out = d if out is None else out.unionByName(d)
    return out


def pct(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), 1)
