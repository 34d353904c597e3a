"""op2: SimHash near-dedup of all documents. Fingerprints are beyond SQL; tests/llm compares with brute force."""

from pyspark.sql import functions as F

from . import simhash
from .common import documents
from .registry import query


@query("op2_simhash_near_dedup")
def op2(spark, sf_dir):
    r = simhash.near_dedup(documents(spark, sf_dir))
    return r.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
