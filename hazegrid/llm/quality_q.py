"""op1: quality rules over all documents."""

from pyspark.sql import functions as F

from . import quality as Q
from .common import documents
from .registry import query

_NAMES = [*Q.RATIOS]
_FENCE = " AND ".join(f"r.{k} <= f.max_{k}" for k in _NAMES)
_BUCKET = "((v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0))"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
c AS (SELECT *, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM w),
g AS (SELECT rid, i, words[i:i + 4] AS gram FROM (SELECT rid, words, unnest(range(1, n_words - 3)) AS i FROM c)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS k FROM g) WHERE k > 1),
rep AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY rid),
r AS (SELECT c.*, coalesce(rep.n_repeat_words, 0) AS n_repeat_words, (word_chars * 1000) // greatest(n_words, 1) AS chars_per_word,
  (n_symbols * 1000) // greatest(n_words, 1) AS symbols_per_word, (n_dup_lines * 1000) // greatest(len(lines), 1) AS dup_lines_share
  FROM c LEFT JOIN rep USING (rid)),
u AS (SELECT lang, source, ratio, {_BUCKET} AS b FROM (
  {" UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, {k}::BIGINT AS v FROM r" for k in _NAMES)})),
s AS (SELECT lang, source, ratio, b, count(*) AS n FROM u GROUP BY ALL), gr AS (SELECT DISTINCT lang, source, ratio FROM s),
sl AS (SELECT lang, ratio, b, sum(n) AS n FROM s GROUP BY ALL), sa AS (SELECT ratio, b, sum(n) AS n FROM s GROUP BY ALL),
tl AS (SELECT lang, ratio, sum(n)::HUGEINT AS in_lang FROM sl GROUP BY ALL), ta AS (SELECT ratio, sum(n)::HUGEINT AS in_all FROM sa GROUP BY ALL),
m AS (SELECT lang, source, ratio, b, sum(w) AS w FROM (
  SELECT s.lang, s.source, s.ratio, s.b, s.n * (in_lang + {Q.PRIOR}) * in_all AS w FROM s JOIN tl ON tl.lang IS NOT DISTINCT FROM s.lang AND tl.ratio = s.ratio JOIN ta ON ta.ratio = s.ratio
  UNION ALL SELECT gr.lang, gr.source, gr.ratio, sl.b, {Q.PRIOR} * sl.n * in_all FROM gr JOIN sl ON sl.lang IS NOT DISTINCT FROM gr.lang AND sl.ratio = gr.ratio JOIN ta ON ta.ratio = gr.ratio
  UNION ALL SELECT gr.lang, gr.source, gr.ratio, sa.b, {Q.PRIOR * Q.PRIOR} * sa.n FROM gr JOIN sa ON sa.ratio = gr.ratio) GROUP BY ALL),
cu AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, ratio ORDER BY b) AS cum, sum(w) OVER (PARTITION BY lang, source, ratio) AS whole FROM m),
p AS (SELECT lang, source, ratio, min(b) FILTER (cum * 4 >= whole) AS lo, min(b) FILTER (cum * 4 >= whole * 3) AS hi FROM cu GROUP BY ALL),
f AS (SELECT lang, source, {", ".join(f"max(CASE WHEN ratio = '{k}' THEN hi + {Q.SPREADS} * greatest(hi - lo, {v}) END) AS max_{k}" for k, v in Q.RATIOS.items())}
  FROM p GROUP BY lang, source)
SELECT r.doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {_FENCE} AS kept
FROM r JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
"""


@query("op1_quality_rules", SQL)
def op1(spark, sf_dir):
    rows, n = Q.judged(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), ["doc_id"])
    return rows.select("doc_id", *(F.col(n[k]).alias(k) for k in [*Q.BASE, "base_failed", "kept"]))
