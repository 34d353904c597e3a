"""op6: words of all documents that lie in benchmark windows."""

from pyspark.sql import functions as F

from . import decontam as D
from .common import documents
from .registry import query

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{D.UPPER}', '{D.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents),
i AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
w AS (SELECT DISTINCT item_id, words[s:s + 9] AS win FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS s
  FROM i WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM w),
p AS (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM d, sizes WHERE len(words) >= n),
h AS (SELECT rid, s, n, item_id FROM (SELECT rid, s, n, words[s:s + n - 1] AS win FROM p) JOIN w USING (win)),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS pos FROM h) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""


@query("op6_benchmark_decontamination", SQL)
def op6(spark, sf_dir):
    r = D.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
    return r.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
