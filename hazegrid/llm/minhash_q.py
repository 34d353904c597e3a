"""op12: near-duplicate documents by b-bit MinHash with links confirmed on full sets."""

from pyspark.sql import functions as F

from . import minhash as M
from .common import documents
from .decontam import LOWER, UPPER
from .registry import query

SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT rid, doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' ')))) AS s
  FROM d WHERE len(w) > 0),
g AS (SELECT s, min(rid) AS nid, min(doc_id) AS least, len(s) AS n FROM t GROUP BY s),
e AS (SELECT nid, n, unnest(s) AS h FROM g),
p AS (SELECT a.nid AS a, b.nid AS b, a.n + b.n AS total, count(*) AS common FROM e a JOIN e b ON a.h = b.h AND a.nid < b.nid
  AND 100 * least(a.n, b.n) >= {M.PERCENT} * greatest(a.n, b.n) GROUP BY 1, 2, 3),
l AS (SELECT a, b FROM p WHERE 100 * common >= {M.PERCENT} * (total - common)),
sides AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(nid, reach) AS (SELECT nid, nid FROM g UNION SELECT r.nid, sides.b FROM r JOIN sides ON sides.a = r.reach),
c AS (SELECT r.nid, min(g.least) AS component_id FROM r JOIN g ON g.nid = r.reach GROUP BY r.nid),
m AS (SELECT t.rid, g.n, c.component_id FROM t JOIN g ON g.s = t.s JOIN c ON c.nid = g.nid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN m.rid IS NULL THEN doc_id ELSE component_id END AS component_id,
  doc_id IS NOT DISTINCT FROM CASE WHEN m.rid IS NULL THEN doc_id ELSE component_id END AS kept
FROM d LEFT JOIN m USING (rid)
"""


@query("op12_minhash_near_dedup", SQL)
def op12(spark, sf_dir):
    r = M.near_dedup(documents(spark, sf_dir))
    return r.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
