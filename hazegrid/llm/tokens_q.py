"""op5: all documents as token ids in files with an index. The tokenizer is beyond SQL; tests/llm encode texts one by one."""

from pyspark.sql import functions as F

from . import tokens
from .common import documents
from .registry import query


@query("op5_token_ids")
def op5(spark, sf_dir):
    import public_tokenizers

    r = tokens.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return r.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))
