"""op3: all documents mixed to source targets."""

from pyspark.sql import functions as F

from . import mixing
from .common import documents
from .registry import query

#: Amounts without slots and blocks: whole passes, plus the head of each source's shuffled order. The slots are the schedule by itself.
SQL = """
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS n FROM d GROUP BY source),
w AS (SELECT source, n, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
o AS (SELECT *, sum(n) OVER () AS total, sum(weight) OVER () AS all_w,
  coalesce(sum(n) OVER x, 0) AS n_before, coalesce(sum(weight) OVER x, 0) AS w_before FROM w
  WINDOW x AS (ORDER BY n::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (150 * total - 200 * n_before) * weight > 200 * n * (all_w - w_before) AS cut FROM o),
t AS (SELECT source, n, CASE WHEN cut THEN (2 * n)::DOUBLE ELSE (weight * (150 * total - 200 * coalesce(sum(n) FILTER (cut) OVER (), 0)))::DOUBLE
  / (100 * greatest(sum(weight) FILTER (NOT cut) OVER (), 1)) END AS target FROM c),
g AS (SELECT source, n, floor(target)::BIGINT AS take, (n + 1023) // 1024 AS blocks FROM t WHERE n > 0),
k AS (SELECT *, take // n AS whole, take % n AS rem, (take // n) * blocks + (take % n + 1023) // 1024 AS slots FROM g),
e AS (SELECT *, sum(slots) OVER (ORDER BY source NULLS LAST) AS hi FROM k WHERE slots > 0),
b AS (SELECT ceil(log2(greatest(max(hi), 1)))::INT AS bits FROM e),
j AS (SELECT e.*, bits, unnest(range((hi - slots)::BIGINT, hi::BIGINT)) AS j FROM e, b),
v AS (SELECT source, n, whole, rem, blocks, coalesce(list_sum(list_transform(range(bits), lambda i: ((j >> i) & 1) << (bits - 1 - i))), 0)::BIGINT AS slot FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM v),
z AS (SELECT source, slot, (rank % blocks) * 1024 AS x, least((rank % blocks) * 1024 + 1024, CASE WHEN rank // blocks = whole THEN rem ELSE n END) AS y FROM r),
p AS (SELECT row_number() OVER () AS rid, doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d),
q AS (SELECT rid, min(slot) AS first_slot FROM p JOIN z ON p.source IS NOT DISTINCT FROM z.source AND p.a < z.y AND p.a + p.size > z.x AND p.size > 0 GROUP BY rid)
SELECT doc_id, size, n::BIGINT AS source_size, target, CASE WHEN n = 0 THEN 0 ELSE size * (floor(target)::BIGINT // n)
  + greatest(0, least(a + size, floor(target)::BIGINT % n) - a) END::BIGINT AS taken, first_slot
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN q USING (rid)
"""


@query("op3_mix_sources", SQL)
def op3(spark, sf_dir):
    r = mixing.amounts(documents(spark, sf_dir))
    return r.select(F.col("id").alias("doc_id"), "size", F.col("n").alias("source_size"), "target", "taken", "first_slot")
