"""Readers and scans. Every reader takes an explicit schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

MISSING = -200.0        # fixed value: missing marker of the locale CSV
CO_MG_TO_PPM = 1164.6   # fixed value: divisor for CO
OPENAQ = T.StructType([
    T.StructField("country", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("coordinates", S.struct(latitude=T.DoubleType(), longitude=T.DoubleType())),
    T.StructField("results", T.ArrayType(S.struct(date=S.struct(utc=T.StringType()), parameter=T.StringType(),
                                                  value=T.StringType(), unit=T.StringType())))])


def table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read if schema is None else spark.read.schema(schema)
    return r.parquet(path)


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A relational table read in ``parts`` ranges of its numeric key, one task each."""
    return (spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=str(low),
                                              upperBound=str(high), numPartitions=str(parts), **options).load())


def time_range(df: DataFrame, ts: str, now: Column, hours: float, fields: Sequence[str] = ()) -> DataFrame:
    """Rows of the last ``hours``; plain comparisons on stored columns, so they reach the scan."""
    start = now - F.make_dt_interval(secs=F.lit(hours * 3600))
    d = df.where((F.col(ts) >= start) & (F.col(ts) < now))
    if "date" in df.columns:  # table partitioned by day: skip whole partitions
        d = d.where(F.col("date").between(F.to_date(start), F.to_date(now)))
    return d.where(F.col("field").isin(*fields)) if fields else d


def training_csv(spark: SparkSession, path: str, schema: T.StructType = S.CALIBRATION_CSV) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def locale_csv(spark: SparkSession, path: str, header: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """``;`` separated, decimal comma, -200 = missing, day-first dates; incomplete rows dropped.

    ``header`` names all columns of the file in order, ``columns`` maps those to keep to new names.
    """
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    raw = spark.read.schema(schema).csv(path, sep=";", header=True)
    num = lambda c: F.expr(f"try_cast(replace(`{c}`, ',', '.') AS DOUBLE)")
    d = raw.select(F.try_to_timestamp(F.concat_ws(" ", "Date", "Time"), F.lit("dd/MM/yyyy HH.mm.ss")).alias("timestamp"),
                   *[F.when(num(old) != MISSING, num(old)).alias(new) for old, new in columns.items()]).dropna()
    return d.withColumn("co_ref", F.col("co_ref") / CO_MG_TO_PPM) if "co_ref" in columns.values() else d


def openaq_long(spark: SparkSession, path: str) -> DataFrame:
    """Nested measurement documents to one row per measurement; nulls, text and negatives dropped."""
    m = spark.read.schema(OPENAQ).json(path).select(
        "country", "city", F.col("coordinates.latitude").alias("lat"), F.col("coordinates.longitude").alias("lon"),
        F.explode("results").alias("m"))
    return m.select(F.try_to_timestamp("m.date.utc").alias("timestamp"), "country", "city", "lat", "lon",
                    F.col("m.parameter").alias("parameter"), F.expr("try_cast(m.value AS DOUBLE)").alias("value"),
                    F.col("m.unit").alias("unit")).where(F.col("value") >= 0)


def feature_rows(store: DataFrame, names: Sequence[str], n_steps: int = 288) -> DataFrame:
    """Last ``n_steps`` rows per zone with the feature map as columns, oldest first within a zone."""
    w = W.partitionBy("zone_id").orderBy(F.col("timestamp").desc())
    top = store.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n_steps)
    return top.select("zone_id", "timestamp", *[F.col("features")[n].alias(n) for n in names])
