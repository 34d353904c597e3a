"""op7: language of all documents; tests/llm measure the held-out accuracy."""

from pyspark.sql import functions as F

from . import langid
from .common import documents
from .registry import query


def third(id_col):
    """Remainder by three of the CRC-32 of the id as text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


@query("op7_language_id")
def op7(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, third("doc_id") != 1)
    r = langid.predict(docs.withColumn("held_out", F.coalesce(third("doc_id") == 1, F.lit(False))), model, also=("held_out",))
    return r.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score", "rejected")
