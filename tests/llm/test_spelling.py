import random
import re
import zlib
from collections import Counter

import pytest

from hazegrid.llm import spelling as S
from tests.llm.helpers import clashing, empty, odd


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_lexicon(docs):
    n = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(lex):
    out = {}
    for w, n in lex.items():
        around = [v for v in lex if near(w, v)]
        best = min(around, key=lambda v: (-lex[v], v)) if around else None
        form = best if best is not None and lex[best] >= 5 * n else None
        out[w] = [n, form, lex[form] if form else None, w, len(around)]
    for w in out:
        r = w
        while out[r][1]:
            r = out[r][1]
        out[w][3] = r
    return {w: tuple(v) for w, v in out.items()}


def got(df):
    return {r["word"]: (r["n"], r["form"], r["form_n"], r["root"], r["n_near"]) for r in df.collect()}


@pytest.mark.parametrize("letters", ["ab", "abcÀé", "abcdefghijklmnop"])
def test_equals_brute_force(spark, letters):
    rnd = random.Random(len(letters))
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(6, 10))) for _ in range(150)}
    for w in list(words):
        i = rnd.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1:], w + "a", w[:-1]}
    lex = {w: rnd.choice((5, 6, 25, 30, 150, 151, 900, 5000)) for w in words if len(w) >= 6}
    d = spark.createDataFrame(list(lex.items()), "word string, n long")
    assert got(S.variants(d)) == brute(lex)


def test_runs_and_long_words(spark):
    lex = {"a" * k: 5 * 6 ** (k % 5) for k in range(6, 14)} | {"a" * 3000 + "b": 5, "a" * 40 + "bc": 100, "a" * 40 + "b": 7, "aaaaab": 500, "baaaaa": 9, "×÷×÷×÷": 5, "×÷×÷×": 30}
    assert got(S.variants(spark.createDataFrame(list(lex.items()), "word string, n long"))) == brute(lex)


def test_a_letter_that_a_third_of_all_words_begin_with(spark):
    rnd = random.Random(8)
    lex = {"qqqq" + "".join(rnd.choice("abcdefghij") for _ in range(4)): rnd.choice((5, 50, 500)) for _ in range(400)}
    lex |= {"".join(rnd.choice("klmnopr") for _ in range(6)): 5 for _ in range(300)}
    assert got(S.variants(spark.createDataFrame(list(lex.items()), "word string, n long").repartition(8))) == brute(lex)


def test_lexicon_equals_plain_count(spark, monkeypatch):
    monkeypatch.setattr(S, "AT_ONCE", 50)
    rnd = random.Random(2)
    vocab = ["".join(rnd.choice("abcDEÜß") for _ in range(rnd.randrange(1, 9))) for _ in range(120)]
    docs = [(i, "-".join(rnd.choice(vocab) for _ in range(60))) for i in range(300)] + [(None, " ".join(vocab)), (None, " ".join(vocab)), (3, None), (4, ""), (3, vocab[0] * 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert {r["word"]: r["n"] for r in S.lexicon(clashing(d, "id", "word", "n")).collect()} == plain_lexicon(docs)


def test_odd_and_empty_tables(spark):
    assert S.variants(S.lexicon(empty(spark))).count() == 0
    words = {r["word"] for r in S.variants(S.lexicon(odd(spark))).collect()}
    assert words == set(plain_lexicon([(r["doc_id"], r["text"]) for r in odd(spark).collect()]))
