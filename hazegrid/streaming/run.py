"""Stream sources and the common way to run a stream to a table."""

from __future__ import annotations

from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def kafka(spark: SparkSession, servers: str, pattern: str, per_trigger: int = 1_000_000, **options: str) -> DataFrame:
    """Messages of all topics that match ``pattern``, as ``topic`` and text ``value``; at most ``per_trigger`` in a micro-batch."""
    return (spark.readStream.format("kafka").options(**{"maxOffsetsPerTrigger": str(per_trigger), "kafka.bootstrap.servers": servers, "subscribePattern": pattern, **options})
            .load().selectExpr("topic", "CAST(value AS STRING) AS value", "timestamp AS received_at"))


def files(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", per_trigger: int = 1000, fmt: str = "parquet") -> DataFrame:
    """New files of a folder; ``per_trigger`` bounds a micro-batch and with it the keyed state work."""
    return (spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", per_trigger).load(folder))


@contextmanager
def settings(spark: SparkSession, conf: Mapping[str, str] | None):
    """Session settings while a stream starts; a stream keeps those it has started with."""
    old = {k: spark.conf.get(k, None) for k in conf or ()}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def to_table(stream: DataFrame, name: str, path: str | None = None, partition: str | tuple[str, ...] | None = None, every: str | None = None,
             checkpoint: str | None = None, conf: Mapping[str, str] | None = None):
    """Append to a parquet table. Without ``every`` the input at hand is processed and the stream ends.

    A job that may be restarted gives both ``path`` and ``checkpoint``: it then goes on where it stopped, with its keyed state.
    ``conf`` are settings of this stream only.
    Returns the table's path and the running query (``None`` when it has ended).
    """
    spark = stream.sparkSession
    if path and not checkpoint:
        raise ValueError("a table at a fixed path needs a fixed checkpoint, or a restart would add its rows again")
    path = path or shared_dir(spark, name)
    w = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint or shared_dir(spark, f"{name}-checkpoint"))
    w = w.partitionBy(*((partition,) if isinstance(partition, str) else partition)) if partition else w
    with settings(spark, conf):
        q = (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start(path)
    if every:
        return path, q
    q.awaitTermination()
    return path, None


def each_batch(stream: DataFrame, name: str, fn, mode: str = "append", every: str | None = None, checkpoint: str | None = None):
    w = stream.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", checkpoint or shared_dir(stream.sparkSession, f"{name}-checkpoint"))
    if every:
        return w.trigger(processingTime=every).start()
    w.trigger(availableNow=True).start().awaitTermination()
    return None
