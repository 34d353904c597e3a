"""Writers and table-state changes, each as a new table state rather than an in-place update."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace existing rows of the same key.

    ``incoming`` may carry ``_seq`` (higher = later); its highest row wins. One partial aggregate,
    so many versions of one key combine before the shuffle.
    """
    cols = existing.columns
    rest = [c for c in cols if c not in keys]
    new = incoming if "_seq" in incoming.columns else incoming.withColumn("_seq", F.lit(1).cast("long"))
    u = existing.withColumn("_seq", F.lit(None).cast("long")).unionByName(new.select(*cols, "_seq"))
    top = F.max_by(F.struct(*rest), F.coalesce("_seq", F.lit(-(2**62)))).alias("_v")
    return u.groupBy(*keys).agg(top).select(*keys, "_v.*").select(*cols)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Existing rows plus the incoming rows whose key is new; of several with one key the first in ``order`` (all other columns if not given)."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*(order or rest))).alias("_v")).select(*keys, "_v.*") if rest else incoming.distinct()
    return existing.unionByName(first.select(*incoming.columns).join(existing.select(*keys), list(keys), "left_anti"))


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace exactly the partitions present in ``df``; a rerun gives the same table.

    Rows are dealt by partition, and a partition with very many rows is split over several tasks and files.
    """
    (df.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def append(df: DataFrame, path: str, partition: str = "date") -> None:
    df.write.mode("append").partitionBy(partition).parquet(path)


def export(readings: DataFrame, zone, start, end, pollutants: Sequence[str]) -> DataFrame:
    """One zone's pollutants in a range of at most 30 days, wide, in fixed column order."""
    if dt.datetime.fromisoformat(end) - dt.datetime.fromisoformat(start) > dt.timedelta(days=30):
        raise ValueError("range longer than 30 days")
    kind = readings.schema["ts"].dataType
    d = readings.where((F.col("zone_id") == zone) & (F.col("ts") >= F.lit(start).cast(kind))
                       & (F.col("ts") < F.lit(end).cast(kind)) & F.col("field").isin(*pollutants))
    # of several values of one pollutant at one time the smallest is written
    return d.groupBy("ts", "sensor_id").pivot("field", list(pollutants)).agg(F.min("value")).select(
        "ts", "sensor_id", *pollutants)


def geojson(snapshots: DataFrame, grid: dict) -> DataFrame:
    """One FeatureCollection document per ``computed_at``: one point per zone, plus grid metadata."""
    point = F.struct(F.lit("Feature").alias("type"),
                     F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
                     F.struct(F.col("pm25_mean").alias("pm25"), F.lit("measurement").alias("type"),
                              F.col("zone").alias("zone")).alias("properties"))
    doc = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("features"),
                             F.struct(*[F.lit(v).alias(k) for k, v in grid.items()]).alias("metadata")))
    return snapshots.groupBy("computed_at").agg(F.sort_array(F.collect_list(point)).alias("features")).select(
        "computed_at", F.size("features").alias("n_points"), doc.alias("geojson"))


def dead_letter(at: Column) -> dict[str, Column]:
    """The fields of a reject record: time, error class, details, raw text and topic."""
    details = F.when(F.size("failed") > 0, F.concat(F.lit("failed: "), F.array_join("failed", ", "))).otherwise("not valid JSON")
    return {"timestamp": at, "error": F.col("error"), "details": details, "raw_payload": F.col("value"), "message_topic": F.col("topic")}


def dead_letters(rejected: DataFrame, at: Column) -> DataFrame:
    return rejected.select(*[c.alias(n) for n, c in dead_letter(at).items()])


def register_models(models: DataFrame) -> DataFrame:
    """Newest row per (name, version); per type only the latest activated one stays active."""
    rest = [c for c in models.columns if c not in ("name", "version")]
    m = (models.groupBy("name", "version").agg(F.max_by(F.struct(*rest), "id").alias("_m"))
         .select("name", "version", "_m.*"))
    last = m.where(F.col("activated_at").isNotNull()).groupBy("type").agg(
        F.max_by("id", F.struct("activated_at", "id")).alias("_active"))
    return m.join(last, "type", "left").withColumn("is_active", F.coalesce(F.col("id") == F.col("_active"), F.lit(False))).drop("_active")


def drop_old(df: DataFrame, ts: str, now: Column, hours: int) -> DataFrame:
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL '{hours}' HOUR"))


def keep_last_n(versions: DataFrame, key: str, ts: str, tie: str, n: int = 3) -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc_nulls_last(ts), F.col(tie).desc())
    return versions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
