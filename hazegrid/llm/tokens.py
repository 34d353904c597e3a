"""Token-id files with a minimal perfect hash index.

A shard holds the ids of its documents one after the other, each document closed by id 0, and at its end a table of the keys and
id counts. Shards are ranges of keys in ascending order, so the shards in order are the whole id stream. They are written by
Spark's text writer, whose line separator is the closing id: every row is one document's raw bytes, the last row the table.
So any store that Spark reaches will do, and a lost task is written anew by its committer.

The index maps a key to shard and place in constant time. Keys fall into parts by hash; each part has a minimal perfect hash
function of bit levels: keys that alone hit a bit of a level are done, the others go on to the next level, and a key's slot is the
number of set bits before its own. A stored 32-bit fingerprint tells keys that are not in the index.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazegrid.session import shared_dir

from .common import saved
from .encoding import encoder

#: Bytes of text per shard, and keys per part of the index.
SHARD_BYTES, PART_KEYS = 64 << 20, 100_000
#: Bits per key left in a level.
GAMMA = 2
MAGIC = 0x31534449
#: Stands for a null key in the files and the index; not allowed as a real key.
NULL_KEY = -(1 << 63)


# ---- shards

def table(keys, counts) -> bytes:
    """The rows at a shard's end: keys, ids per document, their number and a mark."""
    return (np.array(keys, "<i8").tobytes() + np.array(counts, "<u4").tobytes() + np.array([len(keys), MAGIC], "<u8").tobytes())


def parse(content: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and id counts of a shard."""
    end = len(content) - width  # the separator after the table
    n, magic = np.frombuffer(content, "<u8", 2, end - 16)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    n = int(n)
    at = end - 16 - 12 * n
    return np.frombuffer(content, "<i8", n, at), np.frombuffer(content, "<u4", n, at + 8 * n)


def write_shards(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = 2,
                 shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every whole text (null: empty) and write the shards in ascending order of the ids, null ids first.

    Rows with the same id are neighbours, in the order of a hash of their texts; if they are very many, they fill several shards.
    """
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))

    def run(batches):
        enc, keys, counts = encoder(tokenizer, width), [], []
        for b in batches:
            ids, n = enc.encode_array(b.column(1))
            keys.append(b.column(0).to_numpy(zero_copy_only=False))
            counts.append(n + 1)
            yield pa.RecordBatch.from_arrays([ids], ["value"])
        if sum(map(len, keys)):
            yield pa.RecordBatch.from_arrays([pa.array([table(np.concatenate(keys), np.concatenate(counts))], pa.binary())], ["value"])

    d = d.withColumn("hash", F.xxhash64("text")).repartitionByRange(n, "key", "hash").sortWithinPartitions("key", "hash")
    rows = d.select("key", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", "\0" * width).text(f"{path}/shards")


def shard_paths(spark: SparkSession, path: str, shards: set[int] | None = None) -> list[str]:
    """The files of the named shards, or a pattern for all; their contents are not read."""
    if shards is None:
        return [f"{path}/shards/part-*"]
    files = spark.read.format("binaryFile").load(f"{path}/shards/part-*").select("path") if shards else None
    return [r["path"] for r in files.where(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").isin(*shards)).collect()] if shards else []


def stored(spark: SparkSession, path: str, width: int = 2, with_ids: bool = False, shards: set[int] | None = None) -> DataFrame:
    """Each document read back from the shards, from the named ones only if ``shards`` is given: ``(shard, ord, key, at, n, crc[, ids])``;
    ``at`` counts ids from the shard's start, ``n`` includes the closing id, ``crc`` is taken over the ids as 32-bit integers."""
    def run(batches):
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1)):
                content = content.as_py()
                keys, counts = parse(content, width)
                ends = np.cumsum(counts, dtype=np.int64)
                for i in range(0, len(keys), 10_000):
                    c, e = counts[i:i + 10_000], ends[i:i + 10_000]
                    ids = [np.frombuffer(content, f"<u{width}", int(k), int(x - k) * width) for k, x in zip(c, e)]
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                    cols = [pa.array(np.full(len(c), shard, np.int32)), pa.array(np.arange(i, i + len(c))), pa.array(keys[i:i + 10_000]),
                            pa.array(e - c), pa.array(c.astype(np.int64)), pa.array(crc, pa.int64())]
                    names = ["shard", "ord", "key", "at", "n", "crc"]
                    if with_ids:
                        cols.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    try:
        paths = shard_paths(spark, path, shards)
        files = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], "path string, content binary")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], "path string, content binary")  # no documents, no shards
    files = files.where(F.length("content") > 0).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content")
    return files.mapInArrow(run, "shard int, ord long, key long, at long, n long, crc long" + ", ids array<int>" * with_ids)


# ---- index

def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each key."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + 1) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(sizes, bits)`` of the levels for distinct keys; ``bits`` joins all levels."""
    sizes, levels, left = [], [], keys
    while len(left):
        m = max(64, GAMMA * len(left))
        at = (mix(left, len(sizes)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        levels.append(alone)
        left = left[~alone[at]]
    return np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool)


def slots(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level has its bit."""
    rank = np.cumsum(bits) - 1
    out, start, left = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
    for level, m in enumerate(sizes.tolist()):
        at = start + (mix(keys[left], level) % np.uint64(m)).astype(np.int64)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, start = left[~hit], start + m
    return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


INDEX = "part int, parts int, n int, sizes binary, bits binary, prints binary, shard binary, last binary, ord binary, docs binary, at binary"


def write_index(docs: DataFrame, path: str, part_keys: int = PART_KEYS) -> DataFrame:
    """Index the distinct keys of ``docs(key, shard, ord, at)`` under ``path``: where a key's first document lies, how many it has, and the
    last shard that they reach."""
    keys = docs.groupBy("key").agg(F.min(F.struct("shard", "ord", "at")).alias("p"), F.max("shard").alias("last"), F.count(F.lit(1)).alias("docs")).select(
        "key", "p.*", "last", "docs")
    parts = max(1, -(-docs.count() // part_keys))
    keys = keys.withColumns({"parts": F.lit(parts), "part": F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf["key"].to_numpy(np.int64)
        sizes, bits = build(k)
        s = np.argsort(slots(k, sizes, bits))
        col = lambda c, kind: pdf[c].to_numpy()[s].astype(kind).tobytes()
        return pd.DataFrame([[pdf["part"].iloc[0], pdf["parts"].iloc[0], len(k), sizes.astype("<i8").tobytes(), np.packbits(bits).tobytes(),
                              fingerprint(k[s]).astype("<u4").tobytes(), col("shard", "<i4"), col("last", "<i4"), col("ord", "<i8"), col("docs", "<i8"), col("at", "<i8")]],
                            columns=[c.split()[0] for c in INDEX.split(", ")])

    keys.groupBy("part").applyInPandas(run, INDEX).write.parquet(f"{path}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


def lookup(index: DataFrame, keys: DataFrame, parts: int | None = None) -> DataFrame:
    """``(key, shard, last, ord, docs, at)`` for the keys of ``keys(key)`` that the index has."""
    if parts is None:
        parts = (index.agg(F.max("parts")).first() or [None])[0] or 1

    def run(entry: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "shard", "last", "ord", "docs", "at"]
        if entry.empty or want.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        e, k = entry.iloc[0], want["key"].to_numpy(np.int64)
        sizes = np.frombuffer(e["sizes"], "<i8")
        bits = np.unpackbits(np.frombuffer(e["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
        s = slots(k, sizes, bits)
        ok = s >= 0
        ok[ok] = np.frombuffer(e["prints"], "<u4")[s[ok]] == fingerprint(k[ok])
        s = s[ok]
        return pd.DataFrame({"key": k[ok], **{c: np.frombuffer(e[c], t)[s].astype(np.int64) for c, t in
                                              (("shard", "<i4"), ("last", "<i4"), ("ord", "<i8"), ("docs", "<i8"), ("at", "<i8"))}})

    want = keys.select(F.coalesce(F.col("key"), F.lit(NULL_KEY)).alias("key")).distinct()
    want = want.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    return index.groupBy("part").cogroup(want.groupBy("part")).applyInPandas(run, "key long, shard int, last int, ord long, docs long, at long")


# ---- both

def write(docs: DataFrame, path: str | None, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> tuple[str, DataFrame, DataFrame]:
    """Shards and index of ``docs`` under ``path`` (a fresh shared folder if None): the folder, its documents read back, its index."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "token-ids")
    write_shards(docs, path, tokenizer, id_col, text_col, width)
    back = saved(stored(spark, path, width), "stored")
    return path, back, write_index(back, path)


def read(spark: SparkSession, path: str, keys: DataFrame, width: int = 2) -> DataFrame:
    """``(key, ids)`` of the documents of ``keys(key)``: the index names their shards, and no other file is opened."""
    hits = saved(lookup(spark.read.schema(INDEX).parquet(f"{path}/index"), keys), "hits")
    named = {r[0] for r in hits.select(F.explode(F.sequence("shard", "last"))).distinct().collect()}  # as many as files to open
    docs = stored(spark, path, width, with_ids=True, shards=named)
    return docs.join(hits.select("key"), "key").select(F.nullif("key", F.lit(NULL_KEY)).alias("key"), "ids")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = 2, path: str | None = None) -> DataFrame:
    """``(id, start, n_tokens, crc)`` of every document from the files, found through the index by its key.

    ``start`` counts the ids of all documents before it, by the place that the index has for its key. Rows with the same id, or none,
    come one after the other. An empty table writes no shard and gives no rows.
    """
    path, back, index = write(docs, path, tokenizer, id_col, text_col, width)
    hits = lookup(index, docs.select(F.col(id_col).cast("long").alias("key"))).select("key", F.struct("shard", "ord").alias("first"), F.col("at").alias("indexed"))
    per = back.groupBy("shard").agg(F.sum("n").alias("k"))  # one row per shard
    per = per.select("shard", F.coalesce(F.sum("k").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = back.join(hits, "key").join(per, "shard")
    at = F.when(F.struct("shard", "ord") == F.col("first"), F.col("indexed")).otherwise(F.col("at"))  # further documents of a key follow its first
    return out.select(F.nullif("key", F.lit(NULL_KEY)).alias("id"), (F.col("before") + at).alias("start"), F.col("n").alias("n_tokens"), F.col("crc"))
