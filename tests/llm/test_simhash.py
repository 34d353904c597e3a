import random

import numpy as np
import xxhash

from hazegrid.llm import simhash as S
from tests.llm.helpers import clashing, empty, odd, odd_rows


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    root = {i: i for i in fps}
    ids = sorted(fps)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    (a, r), (b, s) = S.anchors(x), S.anchors(y)
    for i in range(len(x)):
        assert set(a[r == i].tolist()) & set(b[s == i].tolist())


def test_fingerprints_and_components_equal_brute_force(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(rnd.choice((3, 40, 200)))) for _ in range(60)]
    for t in list(texts):
        w = t.split()
        for _ in range(3):
            w[rnd.randrange(len(w))] = "CHANGED"
            texts.append(" ".join(w))
    texts += ["", None, "Same text", "SAME  text\n", "x"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in S.near_dedup(d).collect()}
    fps = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r["fp"] & (2 ** 64 - 1) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == slow_components(fps)


def test_dense_group_of_many_values_is_one_component():
    rng = np.random.default_rng(2)
    centre = np.uint64(rng.integers(0, 1 << 63))
    v = {int(centre)}
    while len(v) < 3000:
        x = centre
        for b in rng.choice(64, 3, replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        v.add(int(x))
    f = np.array(sorted(v), np.uint64)
    a, b = S.links(np.zeros(len(f), np.int64), f)
    assert len(a) == len(f) - 1
    assert (np.bitwise_count(a ^ b) <= 4).all()


def test_kept_on_odd_rows(spark):
    d = clashing(odd(spark), "id", "fp", "_own", "_keep")
    out = S.kept(d)
    assert out.columns == d.columns
    ids = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
    assert ids == [1, 3, 6, 7, 8, 9]  # 2 is a copy of 1; 4, 5 and the null text have no words, as 3
    assert S.kept(empty(spark)).count() == 0
    assert S.near_dedup(odd(spark)).count() == len(odd_rows())
