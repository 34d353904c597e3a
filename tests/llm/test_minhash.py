import random
import re

import numpy as np
import pytest

from hazegrid.llm import minhash as M
from tests.llm.helpers import clashing, empty, odd, odd_rows


def plain_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(docs):
    s = [plain_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(docs):
        known = [x for x in ids[find(i)] if x is not None]
        out.append((d, len(s[i]), min(known) if known else None))
    return sorted(out, key=repr)


def run(spark, docs, parts=4):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted(((r["id"], r["n"], r["component_id"]) for r in M.near_dedup(d).collect()), key=repr)


def drifting(rnd, vocab, words, n, edits):
    """Copies that change a little from one to the next, so that the ends of the chain are not similar."""
    w = [rnd.choice(vocab) for _ in range(words)]
    out = []
    for _ in range(n):
        out.append(" ".join(w))
        w = list(w)
        for _ in range(edits):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(M, "CHUNK", 5)  # buckets in several chunks
    rnd = random.Random(parts)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for words, n, edits in ((200, 30, 4), (200, 30, 9), (60, 25, 1), (60, 25, 2), (12, 10, 1), (300, 12, 16)):
        texts += drifting(rnd, vocab, words, n, edits)
    base = [rnd.choice(vocab) for _ in range(150)]
    for _ in range(80):  # one group around a centre, pairs of which lie on both sides of the threshold
        w = list(base)
        for _ in range(rnd.randrange(2, 8)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        texts.append(" ".join(w))
    texts += [texts[3]] * 50 + [texts[0].upper(), " ".join(texts[0].split() * 2), "one two", "ONE\ttwo ", "one", "", None, None]
    rnd.shuffle(texts)
    docs = [(i * 5, t) for i, t in enumerate(texts)] + [(None, texts[7]), (None, "all alone here today"), (None, None), (5, "repeated id with other text"), (5, texts[9])]
    assert run(spark, docs, parts) == brute(docs)


def test_all_links_between_components_are_found_after_failed_ones(spark):
    """Two dense groups whose members are mostly too far apart, joined by one pair only."""
    rnd = random.Random(4)
    base = [f"a{i}" for i in range(240)]
    far = [w if i % 240 not in range(0, 12) else f"z{i}" for i, w in enumerate(base)]

    def copies(w, n, lo):
        out = []
        for k in range(n):
            v = list(w)
            v[lo + 3 * k] = f"c{k}"
            out.append(" ".join(v))
        return out

    one, two = copies(base, 30, 60), copies(far, 30, 130)
    half = [w if i not in range(0, 6) else f"z{i}" for i, w in enumerate(base)]
    docs = list(enumerate(one + two + [" ".join(half)]))
    rnd.shuffle(docs)
    assert run(spark, docs) == brute(docs)


def test_odd_rows(spark):
    d = clashing(odd(spark), "id", "n", "digest", "sig", "bands", "nid", "label", "_least")
    got = sorted(((r["id"], r["n"], r["component_id"]) for r in M.near_dedup(d).collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in odd_rows()])
    assert M.near_dedup(empty(spark)).count() == 0


def test_text_ids(spark):
    d = spark.createDataFrame([("b", "x y z u v"), ("a", "X y z u v"), ("c", None)], "doc_id string, text string")
    assert {r["id"]: r["component_id"] for r in M.near_dedup(d).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_estimate_of_similarity():
    rng = np.random.default_rng(1)
    got = []
    for _ in range(300):
        s = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
        t = np.unique(np.r_[s[:300], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
        a, b = (np.frombuffer(M.signature(M.minima(np.sort(x))), np.uint64) for x in (s, t))
        got.append(M.similarity(int(M.differing(a, b))))
    assert abs(np.mean(got) - 300 / 500) < 0.01
    assert M.similarity(M.most_differing()) > 0.5


def test_estimate_in_sql_equals_numpy(spark):
    rng = np.random.default_rng(2)
    sig = [(bytes(rng.integers(0, 256, 32, dtype=np.uint8)), bytes(rng.integers(0, 256, 32, dtype=np.uint8))) for _ in range(50)] + [(b"\xff" * 32, b"\0" * 32)]
    got = spark.createDataFrame(sig, "a binary, b binary").select("a", "b", M._differ_sql("a", "b").alias("d")).collect()
    for r in got:
        assert r["d"] == int(M.differing(np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint64)))


def test_linked_pairs_share_a_bucket():
    rng = np.random.default_rng(3)
    for _ in range(300):
        s = np.unique(rng.integers(0, 1 << 63, 185, dtype=np.uint64))
        t = np.sort(np.r_[s[:170], rng.integers(0, 1 << 63, 15, dtype=np.uint64)])  # 170 of 200
        assert M.linked(s, t)
        assert set(M.band_keys(M.minima(s)).tolist()) & set(M.band_keys(M.minima(t)).tolist())
