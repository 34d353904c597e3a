import random
import re

from hazegrid.llm import decontam as D
from tests.llm.helpers import PROSE, clashing, empty, odd, odd_rows


def words(t):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[s:s + 10]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, got = words(t), set(), set()
        for win, its in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    got |= its
        out.append((i, len(w), len(hit), sorted(str(x) for x in got if x is not None)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in D.contamination(d, b).collect()), key=repr)


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    vocab = "the of and ÄB cD e1 é 7 zeta über".split()  # frequent words, so that prefixes tie and windows overlap
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice((0, 1, 2, 3, 9, 10, 11, 25))))) for i in range(40)] + [(99, None), (None, "zz yy xx ww vv uu tt ss rr qq")]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(80)) + " " + rnd.choice(items)[1].__str__().upper()) for i in range(60)]
    docs += [(7, None), (7, ""), (7, docs[7][1]), (None, "x zz yy xx ww vv uu tt ss rr qq"), (8, "!!!"), (200, items[5][1] * 2)]
    assert run(spark, docs, items) == brute(docs, items)


def test_few_slots_and_many_windows_give_the_same(spark, monkeypatch):
    """Also with slots that let everything through, and far more windows than documents."""
    rnd = random.Random(6)
    vocab = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice((1, 2, 3, 12, 30))))) for i in range(400)]
    docs = [(i, f"{i} " + " ".join(rnd.choice(vocab) for _ in range(30)) + " " + items[i * 7][1]) for i in range(40)]
    want = brute(docs, items)
    for slots in (1, 7, 1 << 22):
        monkeypatch.setattr(D, "SLOTS", slots)
        assert run(spark, docs, items) == want


def test_clean_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    d = clashing(odd(spark), "id", "mark", "items", "words", "_hit_id")
    out = D.clean(d, bench)
    assert out.columns == d.columns and sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 3, 4, 5, 6, 7, 8, 9]
    none = bench.where("false")
    assert D.clean(d, none).count() == len(odd_rows()) and D.contamination(d, none).where("n_hit > 0").count() == 0
    assert D.contamination(empty(spark), bench).count() == 0
