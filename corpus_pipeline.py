"""From raw documents to a tokenised training mix, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.llm import decontam, mixing, quality, simhash, tokens
from hazegrid.llm.common import documents, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the fences of their language and source reject."""
    rows, n = quality.judged(docs)
    return rows.where(F.col(n["kept"])).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return simhash.kept(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of a benchmark item occurs."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by the schedule of the sources' targets: none, once or twice, the last of a source in part."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix as token-id shards with their index; where each document lies, from the files read back."""
    import public_tokenizers

    r = tokens.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return r.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", simhash_near_dedup),
          ("benchmark decontamination", benchmark_decontamination), ("mixing sources", mixing_sources), ("token ids", token_ids)]
#: The near-dedup fingerprints and the tokenizer are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
