"""Windows that end at any time equal plain sums over the rows."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from hazegrid.operators import panes, sketches

START = 1_704_067_200  # 2024-01-01


def rows(seed, n, base=0.0, zones=3):
    rnd = random.Random(seed)
    out = [(z, START + rnd.uniform(0, 9 * 86400), rnd.choice(("pm25", "pm10")), base + rnd.choice((rnd.gauss(20, 5), 12.0, 12.0))) for z in range(zones) for _ in range(n)]
    out += [(0, START + 86400 * k, "pm25", base + k) for k in range(9)] + [(0, START + 86400 + 300 * k, "pm25", base + 1.5) for k in range(30)]  # on the borders of hours and panes
    out += [(1, START + 3 * 86400 + 1.0, "pm25", None)]
    return out


def frame(spark, data):
    d = spark.createDataFrame([(z, float(t), f, v) for z, t, f, v in data], "zone_id long, t double, field string, value double")
    return d.select("zone_id", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).cast("timestamp_ntz").alias("ts"), "field", "value")


def anchors_of(spark, times):
    d = spark.createDataFrame([(z, float(t)) for z in range(4) for t in times], "zone_id long, s double")
    return d.select("zone_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).cast("timestamp_ntz").alias("t"))


TIMES = [START + 2 * 86400, START + 86400 + 300, START + 86400 + 299.5, START + 5 * 86400 + 7 * 60 + 21.25, START + 8.5 * 86400 + 0.001, START - 50, START + 3600 * 0.75, START + 9.2 * 86400]


def percentile(v, p):
    v = sorted(v)
    at = (len(v) - 1) * p
    lo = math.floor(at)
    return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (at - lo)


@pytest.mark.parametrize("base", [0.0, 1e7])
def test_equals_plain_windows(spark, base):
    data = rows(1, 1500, base)
    r = panes.Rolling(frame(spark, data), {"pm25": (1, 3, 24, 168), "pm10": (1, 6)}, {"pm25": (6, 24)})
    got = {}
    for x in r.stats(anchors_of(spark, TIMES)).collect():
        got[x["zone_id"], round(x["t"].timestamp() * 1000), x["field"]] = x["spans"]
    pct = {(x["zone_id"], round(x["t"].timestamp() * 1000)): (x["a"], x["b"]) for x in r.quantiles(anchors_of(spark, TIMES), "pm25", {"a": (6, 0.5), "b": (24, 0.95)}).collect()}
    for z in range(4):
        for t in TIMES:
            key = round(t * 1000)
            inside = lambda f, k: [v for zz, s, ff, v in data if zz == z and ff == f and v is not None and t - k * 3600 <= round(s, 6) < t]  # noqa: B023,E731
            for f, spans in (("pm25", (1, 3, 24, 168)), ("pm10", (1, 6))):
                for k in spans:
                    v, p = inside(f, k), got[z, key, f][k]
                    if not v:
                        assert p is None or p["n"] == 0
                        continue
                    assert p["n"] == len(v) and p["lo"] == min(v) and p["hi"] == max(v)
                    assert p["mean"] == pytest.approx(statistics.fmean(v), rel=1e-12)
                    if k <= 24 and len(v) > 1:
                        assert math.sqrt(p["m2"] / (len(v) - 1)) == pytest.approx(statistics.stdev(v), rel=1e-6, abs=1e-9 + base * 1e-15)
            v6, v24 = inside("pm25", 6), inside("pm25", 24)
            a, b = pct.get((z, key), (None, None))
            assert (a is None) == (not v6) and (b is None) == (not v24)
            if v6:
                assert a == pytest.approx(percentile(v6, 0.5), rel=1e-12)
            if v24:
                assert b == pytest.approx(percentile(v24, 0.95), rel=1e-12)


def test_an_answer_reads_the_readings_once(spark, tmp_path):
    """Panes are made by one scan and kept; an answer reads the readings once more, for the rows of the end panes."""
    path = str(tmp_path / "readings")
    frame(spark, rows(2, 50)).write.parquet(path)
    r = panes.Rolling(spark.read.parquet(path), {"pm25": (1, 24)}, {"pm25": (24,)})
    a = anchors_of(spark, TIMES[:2])
    for answer in (r.stats(a), r.quantiles(a, "pm25", {"x": (24, 0.5)})):
        plan = answer._jdf.queryExecution().optimizedPlan().toString()
        assert sum(line.rstrip().endswith("parquet") for line in plan.splitlines()) == 1


def test_sketch_rollup_of_many_unrounded_values(spark):
    rnd = random.Random(5)
    data = [(1, START + i * 2.5, "pm25", rnd.lognormvariate(2, 1)) for i in range(60_000)]
    d = frame(spark, data).withColumn("sensor_id", F.pmod(F.xxhash64("value"), F.lit(500)))
    h = sketches.hour_sketches(d)
    day = sketches.joined(h, ["zone_id", "field"], F.date_trunc("month", "window_start"), "w").select("zone_id", *sketches.columns()).first()
    v = sorted(x[3] for x in data)
    assert day["n"] == len(v) and day["min"] == v[0] and day["max"] == v[-1]
    assert day["mean"] == pytest.approx(statistics.fmean(v), rel=1e-12) and day["stddev"] == pytest.approx(statistics.stdev(v), rel=1e-9)
    for p, got in ((0.5, day["p50"]), (0.95, day["p95"])):
        assert abs(sum(x <= got for x in v) / len(v) - p) <= 2 * sketches.rank_error()
    assert abs(day["sensor_count"] - 500) <= 10
    assert h.agg(F.max(F.length("values"))).first()[0] < 12_000  # bounded, however many rows an hour has
