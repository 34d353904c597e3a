"""Scans of dependent steps equal the loops they stand for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.operators import chains, folds, models, regress


def test_affine_scan():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 1000):
        a, b = rng.uniform(-1, 1, n), rng.normal(size=n)
        x, want = 3.0, []
        for i in range(n):
            x = a[i] * x + b[i]
            want.append(x)
        ca, cb = chains.affine_scan(a, b)
        assert np.allclose(ca * 3.0 + cb, want, rtol=1e-12, atol=1e-12)


def test_chain_and_last():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 3000):
        t = np.sort(rng.integers(0, 4 * n, n))
        nxt = np.searchsorted(t, t + 7)
        for start in (0, n // 2, n - 1, n):
            want, i = [], start
            while i < n:
                want.append(i)
                i = int(nxt[i])
            assert chains.chain(nxt, start).tolist() == want
        last = chains.last_of(nxt)
        for i in range(0, n, max(1, n // 20)):
            assert last[i] == chains.chain(nxt, i)[-1]


@pytest.mark.parametrize("q, r", [(0.5, 4.0), (0.0, 4.0), (1e-9, 1.0), (1e3, 1e-3), (5.0, 5.0)])
def test_kalman_steps(q, r):
    p, want = r, []
    for _ in range(2000):
        before = p + q
        k = before / (before + r)
        p = (1 - k) * before
        want.append((k, p))
    gain, var = chains.kalman_steps(r, q, r, np.arange(1, 2001))
    assert np.allclose(gain, [k for k, _ in want], rtol=1e-9) and np.allclose(var, [p for _, p in want], rtol=1e-6)


@pytest.mark.parametrize("q, r", [(0.5, 4.0), (1e-8, 4.0), (0.0, 1.0)])
def test_kalman_over_blocks_equals_the_loop(spark, q, r):
    rnd = random.Random(7)
    data = [(k, i, rnd.gauss(20, 6)) for k, n in (("hot", 3000), ("one", 1), (None, 40)) for i in range(n)]
    d = spark.createDataFrame(data, "k string, i int, z double").withColumn("ts", F.timestamp_seconds("i")).repartition(6)
    got = {(x["k"], x["i"]): (x["x"], x["gain"], x["std"]) for x in folds.kalman(d, ["k"], "ts", "i", "z", q, r, block=64).collect()}
    assert len(got) == len(data)
    state = {}
    for k, i, z in data:
        x, p = state.get(k, (z, r))
        before = p + q
        g = before / (before + r)
        x, p = x + g * (z - x), (1 - g) * before
        state[k] = (x, p)
        assert got[k, i] == pytest.approx((x, g, np.sqrt(p)), rel=1e-7)


def test_cooldown_of_a_dense_key(spark):
    rnd = random.Random(9)
    t = sorted(rnd.randrange(0, 3 * 86400) for _ in range(20_000))
    d = spark.createDataFrame([("a", x) for x in t], "k string, t long").select("k", F.timestamp_seconds("t").alias("ts"))
    want, due = [], None
    for x in t:
        if due is None or x >= due:
            want.append(x)
            due = x + 1800
    assert sorted(int(r["ts"].timestamp()) for r in folds.cooldown(d, ["k"], "ts", 1800).collect()) == want


@pytest.mark.parametrize("share", [0.85, 0.0, 1.0, 0.333])
def test_time_split_finds_the_cut(spark, share):
    rnd = random.Random(2)
    data = [(i, rnd.choice((5.0, 5.0, 7000.25, 7000.25, rnd.uniform(0, 1e5)))) for i in range(997)]
    d = spark.createDataFrame(data, "id int, t double").select("id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"))
    got = {r["id"]: r["is_train"] for r in models.time_split(d, "ts", ["ts", "id"], share).collect()}
    order = sorted(data, key=lambda x: (round(x[1], 6), x[0]))
    want = {i: k < int(len(data) * share) for k, (i, _) in enumerate(order)}
    assert got == want
    assert models.time_split(d.where("false"), "ts", ["ts", "id"], share).count() == 0


def test_group_regressions_equal_least_squares(spark):
    rng = np.random.default_rng(4)
    data, want = [], {}
    for z, n in ((1, 500), (2, 60), (None, 30)):
        x = rng.normal(1e6, 2.0, (n, 3))
        x[:, 2] = 7.0  # constant
        y = x[:, :2] @ [0.5, -2.0] + rng.normal(size=n) + 100
        a = np.column_stack([np.ones(n), x[:, :2] - 1e6])
        w, *_ = np.linalg.lstsq(a, y, rcond=None)
        want[z] = (w[1:], np.sqrt(np.mean((y - a @ w) ** 2)), n)
        data += [(z, *map(float, r), float(v)) for r, v in zip(x, y)]
    data += [(1, None, 1.0, 7.0, 3.0), (1, 1.0, 1.0, 7.0, None), (9, 1.0, 1.0, 1.0, 1.0)]
    d = spark.createDataFrame(data, "z int, a double, b double, c double, y double").repartition(7)
    f = regress.fit(d, ["z"], ["a", "b", "c"], ["y"])
    got = {r["z"]: r for r in f.collect()}
    assert set(got) == {1, 2, None}
    for z, (w, rmse, n) in want.items():
        assert got[z]["n"] == n and got[z]["coefficients"][:2] == pytest.approx(w, rel=1e-6) and got[z]["coefficients"][2] == 0
        assert got[z]["rmse"] == pytest.approx(rmse, rel=1e-6) and got[z]["gradient"] < 1e-9
    p = regress.predict(d.where("z = 2"), f, ["z"], ["a", "b", "c"], ["z", "a", "y"]).collect()
    assert all(x["ci_lower"] <= x["predicted_value"] <= x["ci_upper"] for x in p)
