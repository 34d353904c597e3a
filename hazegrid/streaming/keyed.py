"""A table whose rows a stream replaces by key.

Every micro-batch writes the rows it changed under its number, so a batch that is run again replaces its own rows only. Every few
batches the newest row of each key is written out as a base, and what lies before the base before that is removed. Readers take the
newest base and the batches after it. Readers and writers need a shared folder and no server.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """``keys`` identify a row; of several, the one of the latest batch counts, or first the highest ``order`` if given."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = (), every: int = 16):
        self.spark, self.path, self.keys, self.order, self.every = spark, path.rstrip("/"), list(keys), list(order), every

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the completely written folders of one kind."""
        fs, path = self._fs()
        top = path(f"{self.path}/{kind}")
        if not fs.exists(top):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(top) if fs.exists(path(f"{self.path}/{kind}/{s.getPath().getName()}/_SUCCESS")))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: the changed rows of one micro-batch, at most one per key."""
        batch.write.mode("overwrite").parquet(f"{self.path}/batch/{batch_id:012d}")
        if (batch_id + 1) % self.every == 0:
            self.compact(batch_id)

    def _files(self, upto: int | None) -> list[str]:
        within = lambda ns: [n for n in ns if upto is None or n <= upto]
        bases = within(self._numbers("base"))
        new = [n for n in within(self._numbers("batch")) if not bases or n > bases[-1]]
        return [f"{self.path}/base/{n:012d}" for n in bases[-1:]] + [f"{self.path}/batch/{n:012d}" for n in new]

    def read(self, upto: int | None = None) -> DataFrame:
        """The table as of a batch, or now."""
        files = self._files(upto)
        if not files:
            raise FileNotFoundError(f"nothing written to {self.path} yet")
        d = self.spark.read.parquet(*files).withColumn("_no", F.regexp_extract(F.input_file_name(), r"/(?:base|batch)/(\d+)/", 1).cast("long"))
        rest = [c for c in d.columns if c not in (*self.keys, "_no")]
        top: Column = F.max_by(F.struct(*rest), F.struct(*self.order, "_no")).alias("_v")
        return d.groupBy(*self.keys).agg(top).select(*self.keys, "_v.*")

    def compact(self, upto: int) -> None:
        """Write the newest rows as of ``upto`` as a base; drop what lies before the base before it, which readers may still use."""
        old = self._numbers("base")
        self.read(upto).write.mode("overwrite").parquet(f"{self.path}/base/{upto:012d}")
        keep = [n for n in old if n < upto][-1:]
        fs, path = self._fs()
        for kind in ("base", "batch"):
            for n in self._numbers(kind):
                if keep and (n < keep[0] or (kind == "batch" and n == keep[0])):
                    fs.delete(path(f"{self.path}/{kind}/{n:012d}"), True)
