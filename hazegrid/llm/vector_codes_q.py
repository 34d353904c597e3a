"""op11: all vectors as codes of 16 bytes with their errors."""

from pyspark.sql import functions as F

from . import vector_codes as V
from .common import saved
from .registry import query

_NEAR = """{a} AS (SELECT r, p, arg_min(e, dist * 1000 + e) AS e, min(dist) AS dist FROM (
  SELECT r, x.p, e, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS dist FROM x JOIN {c} c ON x.p = c.p AND x.k = c.k GROUP BY r, x.p, e) GROUP BY r, p)"""
_MEAN = """{d} AS (SELECT c.p, c.e, c.k, coalesce(m.v, c.v) AS v FROM {c} c LEFT JOIN (
  SELECT p, e, k, ((s - ((s % n) + n) % n) // n)::BIGINT AS v FROM (SELECT a.p, a.e, x.k, sum(x.v)::BIGINT AS s, count(*) AS n
    FROM {a} a JOIN x ON x.r = a.r AND x.p = a.p GROUP BY a.p, a.e, x.k)) m ON m.p = c.p AND m.e = c.e AND m.k = c.k)"""
SQL = f"""
WITH kept AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS (SELECT r, (i // w)::INT AS p, (i % w)::INT AS k, floor(256 * embedding[i + 1]::DOUBLE)::BIGINT AS v
  FROM (SELECT r, embedding, len(embedding) // {V.PARTS} AS w, unnest(range(len(embedding))) AS i FROM kept)),
c0 AS (SELECT p, (r - 1)::INT AS e, k, v FROM x WHERE r <= {V.ENTRIES}),
{_NEAR.format(a="a0", c="c0")},
{_MEAN.format(a="a0", c="c0", d="c1")},
{_NEAR.format(a="a1", c="c1")},
{_MEAN.format(a="a1", c="c1", d="c2")},
{_NEAR.format(a="a2", c="c2")},
f AS (SELECT r, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a2 GROUP BY r),
s AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN f USING (r), s
"""


@query("op11_vector_codes", SQL)
def op11(spark, sf_dir):
    coded, books = V.codes(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
    r = V.with_label_error(saved(coded, "codes"))
    return r.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(V.digest(books)).alias("codebooks_sha256"))
