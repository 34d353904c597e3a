import math

import numpy as np
import pytest

from hazegrid.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Plain loops over Python integers."""
    good = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(good[0][1]) // parts
    cut = [[r[1][p * w:p * w + w] for p in range(parts)] for r in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        at = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at) if a[p] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(r[0], r[2], bytes(nearest(p, c[p])[1] for p in range(parts)), sum(nearest(p, c[p])[0] for p in range(parts))) for r, c in zip(good, cut)]
    return sorted(out, key=repr), books


def rows(n, dims=32, seed=0):
    rng = np.random.default_rng(seed)
    return [(int(i) * 3, [float(np.float32(x)) for x in rng.normal(0, 0.3, dims)], int(rng.integers(0, 4))) for i in rng.permutation(n)]


@pytest.mark.parametrize("n", [1, 40, 300])
def test_equals_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(V, "BLOCK", 37)
    r = rows(n, seed=n)
    coded, books = V.codes(spark.createDataFrame(r, SCHEMA).repartition(5))
    want, wbooks = brute(r)
    assert sorted(((x["id"], x["label"], bytes(x["code"]), x["error"]) for x in coded.collect()), key=repr) == want
    assert books.tolist() == wbooks


def test_odd_rows(spark):
    r = rows(80)
    bad = [(1, None, 1), (2, [], 1), (3, [None] + r[0][1][1:], 1), (4, [math.nan] + r[0][1][1:], 1), (5, [-math.inf] + r[0][1][1:], 1)]
    r += [(6, r[1][1], None), (6, r[2][1], None), (6, r[2][1], None), (None, r[3][1], 2), (None, r[4][1], None)]  # ties, repeats, nulls
    d = spark.createDataFrame(r + bad + [(7, [0.5] * 7, 1), (8, [0.5] * 16, 1)], SCHEMA)
    coded, books = V.codes(d.selectExpr("*", "'x' AS id", "'x' AS code", "'x' AS vec", "'x' AS error", "'x' AS salt"))
    want, wbooks = brute(r)
    got = V.with_label_error(coded).collect()
    assert sorted(((x["id"], x["label"], bytes(x["code"]), x["error"]) for x in got), key=repr) == want and books.tolist() == wbooks
    sums = {}
    for _, lab, _, e in want:
        sums[lab] = sums.get(lab, 0) + e
    assert {x["label"]: x["label_error"] for x in got} == sums


def test_empty_table_and_only_bad_rows(spark):
    for d in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, None, None), (2, [math.nan] * 16, 3)], SCHEMA)):
        coded, books = V.codes(d)
        assert V.with_label_error(coded).count() == 0 and books.size == 0


def test_large_components(spark):
    big = [(i, [float(i * 2 ** 12 + j) for j in range(16)], 0) for i in range(70)]
    coded, books = V.codes(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int"))
    want, wbooks = brute(big)
    assert sorted(((x["id"], x["label"], bytes(x["code"]), x["error"]) for x in coded.collect()), key=repr) == want
    with pytest.raises(Exception, match="too large"):
        V.codes(spark.createDataFrame([(1, [1e30] * 16, 0)], "vec_id long, embedding array<double>, label int"))


def test_codes_stand_for_near_vectors(spark):
    r = rows(500, seed=9)
    coded, books = V.codes(spark.createDataFrame(r, SCHEMA))
    by = {i: np.array(v) for i, v, _ in r}
    off = [np.square(V.decoded(x["code"], books) + 0.5 / 256 - by[x["id"]]).sum() / np.square(by[x["id"]]).sum() for x in coded.collect()]
    assert np.mean(off) < 0.1
