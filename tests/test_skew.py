"""Chunked operators against brute force, with one key holding most rows and tiny chunks and blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazegrid.operators import folds, joins, scan, windows


def frame(n=400, seed=3, hot=0.6, nulls=False):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < hot, 0, rng.integers(1, 6, n)).astype(float)
    if nulls:
        key[rng.random(n) < 0.1] = np.nan
    t = np.sort(rng.integers(0, 6 * 3600, n))
    return pd.DataFrame({"id": np.arange(n), "k": key, "t": t, "v": rng.integers(0, 50, n)})


def spark_frame(spark, pdf):
    rows = [(int(r.id), None if np.isnan(r.k) else int(r.k), int(r.t), float(r.v)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "id long, k int, t long, v double").withColumn("ts", F.timestamp_seconds("t"))


def test_running_with_null_keys(spark):
    pdf = frame(nulls=True)
    d = spark_frame(spark, pdf)
    got = scan.running(d, ["k"], "ts", ["ts", "id"], {"s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "hi": ("max", F.col("v")),
                                                      "lo": ("min", F.col("v")), "p": ("last", F.col("v"))}, chunk_s=600, inclusive=False)
    want = {}
    for _, g in pdf.groupby("k", dropna=False):
        g = g.sort_values(["t", "id"])
        for i, r in enumerate(g.itertuples()):
            b = g["v"].iloc[:i]
            want[r.id] = (b.sum(), i, b.max(), b.min(), b.iloc[-1]) if i else (None, 0, None, None, None)
    assert {r.id: (r.s, r.n, r.hi, r.lo, r.p) for r in got.collect()} == want


def test_blocks_with_halo(spark):
    pdf = frame()
    got = scan.row_windows(spark_frame(spark, pdf), ["k"], "ts", ["ts", "id"],
                           lambda w: {"a": F.lag("v", 7).over(w), "b": F.lead("v", 5).over(w), "m": windows.full(w, 8, F.avg(F.col("v")), F.col("v"))},
                           before=8, after=5, block=16)
    g = pdf.sort_values(["k", "t", "id"]).groupby("k")["v"]
    s = pdf.sort_values(["k", "t", "id"])
    want = pd.DataFrame({"id": s["id"], "a": g.shift(7), "b": g.shift(-5), "m": g.transform(lambda x: x.rolling(8).mean())}).set_index("id")
    have = got.select("id", "a", "b", "m").toPandas().set_index("id").sort_index()
    pd.testing.assert_frame_equal(have.astype(float), want.sort_index().astype(float))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_asof(spark, direction, inclusive):
    a, b = frame(seed=1), frame(seed=2)
    r = spark_frame(spark, b).select("k", "ts", F.col("id").alias("rid"), F.col("v").alias("rv"))
    got = scan.asof(spark_frame(spark, a), r, ["k"], "ts", "ts", ["rid"], ["rid", "rv"], direction, inclusive, chunk_s=600)
    want = {}
    for x in a.itertuples():
        c = b[(b.k == x.k)]
        if direction == "backward":
            c = c[c.t <= x.t] if inclusive else c[c.t < x.t]
            c = c.sort_values(["t", "id"]).tail(1)
        else:
            c = c[c.t >= x.t] if inclusive else c[c.t > x.t]
            c = c.sort_values(["t", "id"]).head(1)
        want[x.id] = int(c["id"].iloc[0]) if len(c) else None
    assert {g.id: g.rid for g in got.collect()} == want


def test_nearest_and_interval(spark):
    a, b = frame(seed=4, n=200), frame(seed=5, n=200)
    l, r = spark_frame(spark, a).drop("v"), spark_frame(spark, b).select("k", "ts", F.col("id").alias("rid"), "v")
    near = {x.id: x.v for x in joins.nearest(l, r, ["k"], "ts", "ts", ["rid"], "v", 300).collect()}
    mean = {x.id: x.m for x in joins.interval_mean(l, "id", r, ["k"], "ts", "ts", "v", 900, "m").collect()}
    for x in a.itertuples():
        c = b[b.k == x.k]
        w = c[(c.t >= x.t - 900) & (c.t <= x.t)]["v"]
        assert mean[x.id] == (pytest.approx(w.mean()) if len(w) else None)
        c = c.assign(d=(c.t - x.t).abs())
        c = c[c.d <= 300]
        if not len(c):
            assert near[x.id] is None
        else:  # of several rows at the best distance any row of the earliest such time is right
            best = c[c.d == c.d.min()]
            assert near[x.id] in set(best[best.t == best.t.min()]["v"])


def test_cooldown_over_many_days(spark):
    pdf = frame(n=600)
    got = folds.cooldown(spark_frame(spark, pdf), ["k"], "ts", 700, chunk_us=900 * 1_000_000)
    want = set()
    for k, g in pdf.groupby("k"):
        due = -1
        for t in sorted(set(g["t"])):
            if t >= due:
                want.add((int(k), int(t)))
                due = t + 700
    assert {(r.k, r.t) for r in got.select("k", F.unix_timestamp("ts").alias("t")).collect()} == want


def test_kalman_blocks_equal_one_pass(spark):
    pdf = frame(n=3000)
    got = {r.id: r.x for r in folds.kalman(spark_frame(spark, pdf), ["k"], "ts", "id", "v", block=200).collect()}
    for _, g in pdf.groupby("k"):
        x, p = float(g["v"].iloc[0]), 4.0
        for r in g.itertuples():
            p += 0.5
            k = p / (p + 4.0)
            x += k * (r.v - x)
            p *= 1 - k
            assert got[r.id] == pytest.approx(x, abs=1e-12)


def test_spatiotemporal(spark):
    rng = np.random.default_rng(9)
    zones = spark.createDataFrame([(i, 3, -17.5 + 0.01 * i, 14.7, 0.01) for i in range(5)], "zone_id int, niveau int, lon_c double, lat_c double, half double")
    an = [(i, int(z), int(t)) for i, (z, t) in enumerate(zip(np.where(rng.random(300) < 0.6, 2, rng.integers(0, 5, 300)), rng.integers(0, 20000, 300)))]
    rp = [(i, int(t), -17.5 + 0.04 * rng.random(), 14.7 + 0.01 * rng.random()) for i, t in enumerate(rng.integers(0, 20000, 40))]
    a = spark.createDataFrame(an, "id int, zone_id int, t long").withColumn("detected_at", F.timestamp_seconds("t"))
    r = spark.createDataFrame(rp, "report_id int, t long, lon double, lat double").withColumn("created_at", F.timestamp_seconds("t"))
    got = {(x.report_id, x.anomaly_id) for x in joins.spatiotemporal(r, a, zones).collect()}
    want = set()
    for i, t, lon, lat in rp:
        near = {z for z in range(5) if 2 * 6371 * np.arcsin(np.sqrt(np.sin(np.radians(14.7 - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(
            np.radians(14.7)) * np.sin(np.radians(-17.5 + 0.01 * z - lon) / 2) ** 2)) <= 2}
        c = sorted([(b, j) for j, z, b in an if z in near and t - 7200 <= b <= t + 1800], reverse=True)[:10]
        want |= {(i, j) for _, j in c}
    assert got == want


def test_interval_mean_ignores_what_lies_outside(spark):
    rows = [(1, 0, float("nan")), (1, 10, 1e17), (1, 7200, 2.0), (1, 7300, 4.0), (None, 7300, 7.0), (1, 99999, 1e17)]
    r = spark.createDataFrame(rows, "k int, t long, v double").withColumn("ts", F.timestamp_seconds("t"))
    l = spark.createDataFrame([(1, 1, 7500), (2, 1, 7200), (3, 1, 20000), (4, 1, 5)], "id int, k int, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {x.id: x.m for x in joins.interval_mean(l, "id", r, ["k"], "ts", "ts", "v", 900, "m").collect()}
    assert (got[1], got[2], got[3]) == (3.0, 2.0, None) and np.isnan(got[4])


def test_cooldown_keeps_null_keys(spark):
    d = spark.createDataFrame([(None, 0), (None, 10), (None, 40), (1, 0), (1, 5), (1, 31)], "k int, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.k, r.t) for r in folds.cooldown(d, ["k"], "ts", 30).select("k", F.unix_timestamp("ts").alias("t")).collect()}
    assert got == {(None, 0), (None, 40), (1, 0), (1, 31)}


def test_slow_kalman_needs_no_warm_up(spark):
    """However slowly a filter forgets, blocks go on from the exact value before them."""
    pdf = frame(n=50)
    for q in (1e-6, 1e-12):
        got = {r["id"]: r["x"] for r in folds.kalman(spark_frame(spark, pdf), ["k"], "ts", "id", "v", q=q, block=8).collect()}
        for _, g in pdf.sort_values(["k", "t", "id"]).groupby("k"):
            x, p = g["v"].iloc[0], 4.0
            for i, v in zip(g["id"], g["v"]):
                prior = p + q
                k = prior / (prior + 4.0)
                x, p = x + k * (v - x), (1 - k) * prior
                assert got[i] == pytest.approx(x, rel=1e-6)
