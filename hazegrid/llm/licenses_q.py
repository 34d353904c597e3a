"""op10: known licence texts in all documents."""

from pyspark.sql import functions as F

from . import licenses as L
from .common import documents
from .registry import query


def _text(s):
    return "'" + s.replace("'", "''") + "'"


def _plain(x):
    x = f"regexp_replace(lower(coalesce({x}, '')), {_text(L.COPYRIGHT)}, '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, {_text(L.PUNCTUATION)}, ' ', 'g'), '[ \\t\\x0B\\f\\r]+', ' ', 'g')"
    return f"regexp_replace({x}, ' ?\\n ?', chr(10), 'g')"


def _flat(x):
    return f"trim(regexp_replace({x}, '[\\x20\\x09-\\x0D]+', ' ', 'g'))"


_SPELL = "CASE w " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in L.SPELLINGS.items()) + " ELSE w END"
_DIGEST = f"sha256(array_to_string(list_transform(string_split(words, ' '), lambda w: {_SPELL}), ' '))"
SQL = f"""
WITH k AS (SELECT DISTINCT license_id, len(string_split(words, ' ')) AS n_words, {_DIGEST} AS digest FROM (
  SELECT license_id, {_flat(_plain("text"))} AS words FROM (VALUES {", ".join(f"({_text(a)}, {_text(b)})" for a, b in L.KNOWN)}) v(license_id, text))),
d AS (SELECT doc_id, regexp_replace(trim({_plain("text")}, ' ' || chr(10)), '\\n{{2,}}', chr(10) || chr(10), 'g') AS p FROM documents),
u AS (SELECT doc_id, 'text' AS unit, 0 AS pos, {_flat("p")} AS words FROM d WHERE contains(p, chr(10) || chr(10))
  UNION ALL SELECT doc_id, 'block', i - 1, {_flat("b[i]")} FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i
    FROM (SELECT doc_id, string_split(p, chr(10) || chr(10)) AS b FROM d)) WHERE contains(b[i], chr(10))
  UNION ALL SELECT doc_id, 'line', i - 1, trim(b[i]) FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i
    FROM (SELECT doc_id, string_split(p, chr(10)) AS b FROM d)))
SELECT doc_id, license_id, unit, pos::INT AS pos, n_words::INT AS n_words
FROM (SELECT *, {_DIGEST} AS digest FROM u WHERE words <> '') JOIN k USING (digest)
"""


@query("op10_license_scan", SQL)
def op10(spark, sf_dir):
    r = L.scan(documents(spark, sf_dir), L.catalogue(spark))
    return r.select(F.col("id").alias("doc_id"), "license_id", "unit", "pos", "n_words")
