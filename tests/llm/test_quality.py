import re

from pyspark.sql import functions as F

from hazegrid.llm import quality as Q
from tests.llm.helpers import PROSE, clashing, empty, odd, odd_rows


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i:i + 5]), []).append(i)
    rep = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep)


def test_counts_equal_brute_force(spark):
    texts = [t for _, t, *_ in odd_rows()] + ["a b c d e f a b c d e", "x " * 400, "l1 x\nl1 x\n\n l1 x\nl2", "a b c d e a b c d e a b c d e", "# $ | a<b>c\n"]
    d = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id int, text string, lang string, source string")
    rows, n = Q.measured(d)
    got = {r["doc_id"]: tuple(r[n[k]] for k in Q.BASE) for r in rows.collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_odd_rows_clashing_names_and_no_rows(spark):
    d = clashing(odd(spark), "_kept", "_flat", "flat", "kept", "ratio", "b")
    rows, n = Q.judged(d)
    out = rows.collect()
    assert len(out) == len(odd_rows()) and set(d.columns) < set(rows.columns)
    assert {r["doc_id"]: r[n["kept"]] for r in out if r["doc_id"] in (3, 4, 5)} == {3: False, 4: False, 5: False}
    assert Q.judged(empty(spark))[0].count() == 0


def test_fences_follow_their_group(spark):
    """A source that writes with many symbols keeps its documents; the same text elsewhere is out."""
    sym = " ".join(w + " #" for w in PROSE.split())
    rows = [(i, f"{PROSE} {i}", "en", "plain") for i in range(200)] + [(1000 + i, f"{sym} {i}", "en", "code") for i in range(200)] + [(9999, sym, "en", "plain")]
    out, n = Q.judged(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string"))
    bad = {r["doc_id"] for r in out.collect() if not r[n["kept"]]}
    assert bad == {9999}


def test_one_more_document_moves_a_fence_a_little(spark):
    """A group's fence goes over from its language's to its own without a jump."""
    sym = " ".join(w + " #" for w in PROSE.split())
    last = None
    for n in (5, 20, 49, 50, 51, 80, 300):
        rows = [(f"{PROSE} {i}", "en", "plain") for i in range(400)] + [(f"{sym} {i}", "en", "code") for i in range(n)]
        d, names = Q.measured(spark.createDataFrame(rows, "text string, lang string, source string"))
        f = {r["source"]: r["max_symbols_per_word"] for r in Q.fences(d.select("lang", "source", *(F.col(names[k]).alias(k) for k in Q.RATIOS))).collect()}
        assert n not in (50, 51) or f["code"] == last
        last = f["code"]


def test_bucket_keeps_five_digits(spark):
    got = [r[0] for r in spark.range(1000).select(Q.bucket(__import__("pyspark").sql.functions.col("id"))).collect()]
    assert all(g <= v and (v - g) * 16 <= v for v, g in enumerate(got)) and len(set(got)) < 120
