"""op4: passages that repeat across all documents. Hash windows are beyond SQL; tests/llm compare with brute force."""

from . import passages
from .common import documents
from .registry import query


@query("op4_repeated_passages")
def op4(spark, sf_dir):
    return passages.repeated(documents(spark, sf_dir))
