"""op8: toxicity of all documents; tests/llm measure it on held-out labels and on misspelled words."""

from pyspark.sql import functions as F

from . import toxicity
from .common import documents
from .registry import query


def fifth(id_col):
    """Remainder by five of the CRC-32 of the id as text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.fit(docs, labels, fifth("doc_id") != 0)
    r = toxicity.predict(docs.withColumn("held_out", F.coalesce(fifth("doc_id") == 0, F.lit(False))), model, also=("held_out",))
    return r.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")
