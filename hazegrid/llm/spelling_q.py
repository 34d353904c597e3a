"""op13: spelling variants of the words of all documents and the forms they lead to."""

from . import spelling as S
from .common import documents
from .decontam import LOWER, UPPER
from .registry import query

_PLACE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
#: Damaged words come from (document, word) pairs, near words from equal rests after the deletion of one character.
SQL = f"""
WITH RECURSIVE crc AS (SELECT {_PLACE} AS t),
o AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents)
  GROUP BY ALL),
k AS (SELECT *, concat(doc_id, ':', w) AS s FROM o WHERE length(w) >= {S.MIN_LENGTH}),
h AS (SELECT doc_id, w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(s) + 1), lambda i: ('0x' || substr(hex(s), (2 * i - 1)::INT, 2))::BIGINT)),
  lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM k, crc),
f AS (SELECT n, CASE WHEN doc_id IS NOT NULL AND h % {S.DAMAGE} = 0 THEN w[:(h % length(w))::BIGINT] || w[(h % length(w))::BIGINT + 2:] ELSE w END AS word FROM h),
l AS (SELECT word, sum(n)::BIGINT AS n FROM f WHERE length(word) >= {S.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {S.MIN_COUNT}),
cut AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM l)),
near AS (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN l b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN l b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS form_n FROM near GROUP BY word),
form AS (SELECT best.word, n_near, form_n, min(near.near) AS form FROM best JOIN near ON near.word = best.word AND near.n = form_n GROUP BY ALL),
v AS (SELECT l.word, l.n, CASE WHEN form_n >= {S.RATIO} * l.n THEN form END AS form, CASE WHEN form_n >= {S.RATIO} * l.n THEN form_n END::BIGINT AS form_n,
  coalesce(n_near, 0)::BIGINT AS n_near FROM l LEFT JOIN form USING (word)),
up(word, root, step) AS (SELECT word, word, 0 FROM v UNION ALL SELECT up.word, v.form, step + 1 FROM up JOIN v ON v.word = up.root WHERE v.form IS NOT NULL)
SELECT word, n, form, form_n, arg_max(up.root, step) AS root, n_near FROM v JOIN up USING (word) GROUP BY ALL
"""


@query("op13_spelling_variants", SQL)
def op13(spark, sf_dir):
    return S.variants(S.lexicon(documents(spark, sf_dir)))
