"""op9: secrets in all documents. A forest is beyond SQL; tests/llm check the candidates and what it decides."""

from pyspark.sql import functions as F

from . import secret_scan
from .common import documents
from .registry import query


@query("op9_secret_scan")
def op9(spark, sf_dir):
    return secret_scan.scan(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id").withColumn("probability", F.round("probability", 6))
