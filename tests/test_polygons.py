"""Points in polygon zones equal the even-odd rule over all border pieces."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hazegrid.operators import govern, polygons

SCHEMA = "zone_id long, niveau int, rings array<array<struct<lon:double,lat:double>>>"


def star(x, y, r, n, dent=0.45, turn=0.0):
    return [(x + r * (1 - dent * (k % 2)) * math.cos(turn + 2 * math.pi * k / n), y + r * (1 - dent * (k % 2)) * math.sin(turn + 2 * math.pi * k / n)) for k in range(n)]


def inside(polygon, x, y):
    odd = False
    for ring in polygon:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


ZONES = {
    1: (3, [star(0.05, 0.05, 0.04, 12)]),
    2: (3, [star(0.07, 0.06, 0.045, 10, turn=0.3), star(0.07, 0.06, 0.01, 4, 0)]),  # with a hole
    3: (3, [[(0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.05, 0.02), (0.0, 0.1)]]),  # concave
    4: (3, [[(0.0, 0.0), (0.0, 0.0003), (0.0003, 0.0)]]),  # smaller than a cell
    5: (1, [star(0.2, 0.2, 1.5, 400, 0.02), star(0.2, 0.2, 0.3, 30)]),  # city-sized, with a hole that holds an island
    6: (2, [[(0.02 * (k % 5), 0.02 * (k // 5)) for k in (0, 4, 24, 20)]]),  # edges on cell borders
    7: (3, [[(0.5, 0.5), (0.6, 0.6)]]),  # no area
    8: (2, [[(-0.4, -0.4), (-0.1, -0.4), (-0.1, -0.1), (-0.4, -0.1)], star(-0.25, -0.25, 0.1, 8, 0), star(-0.25, -0.25, 0.05, 8, 0)]),
}


def frame(spark, zones):
    return spark.createDataFrame([(i, n, [[{"lon": float(x), "lat": float(y)} for x, y in r] for r in p]) for i, (n, p) in zones.items()], SCHEMA)


@pytest.mark.parametrize("finest, doublings", [(0.005, 6), (0.05, 0), (0.001, 9)])
def test_equals_brute_force(spark, finest, doublings):
    rnd = random.Random(1)
    pts = [(rnd.uniform(-0.5, 0.7), rnd.uniform(-0.5, 0.7)) for _ in range(1500)] + [(rnd.uniform(-0.02, 0.13), rnd.uniform(-0.02, 0.13)) for _ in range(1500)]
    pts += [(0.02 * a, 0.02 * b) for a in range(6) for b in range(6)] + [v for _, (_, p) in ZONES.items() for r in p[:1] for v in r[:12]]
    pts += [(0.005 * a + 1e-12, 0.005 * b) for a in range(12) for b in range(12)]
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)] + [(-1, None, 0.05), (-2, 0.05, None)], "id long, lon double, lat double")
    got = {r["id"]: sorted(z["zone_id"] for z in r["zones"] or ()) for r in polygons.containing(p, frame(spark, ZONES), finest=finest, doublings=doublings).collect()}
    want = {i: [z for z, (_, poly) in ZONES.items() if inside(poly, x, y)] for i, (x, y) in enumerate(pts)} | {-1: [], -2: []}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_large_zone_has_few_cells_and_short_pieces():
    wide = [[{"lon": x, "lat": y} for x, y in star(0.2, 0.2, 1.5, 400, 0.02)]]
    c = polygons.cells(wide)
    inner = [x for x in c if x[4] is None]
    assert len(inner) < 4000 < 7 * 1.5 ** 2 / 0.005 ** 2  # the finest cells alone would be some 280 000
    assert max(len(x[4]) for x in c if x[4] is not None) < 10


def test_choice_of_zone(spark):
    p = polygons.containing(spark.createDataFrame([(0.06, 0.05), (5.0, 5.0)], "lon double, lat double"), frame(spark, ZONES))
    got = [(r["s"], r["d"]) for r in p.orderBy("lon").select(polygons.smallest(F.col("zones")).alias("s"), polygons.deepest(F.col("zones")).alias("d")).collect()]
    best = min((polygons.area([[{"lon": x, "lat": y} for x, y in r] for r in poly]), z) for z, (n, poly) in ZONES.items() if n == 3 and inside(poly, 0.06, 0.05))[1]
    assert got == [(best, 1), (None, None)]


def test_published_positions_stay_in_their_zone(spark):
    zones = frame(spark, {1: ZONES[1], 2: ZONES[2], 5: ZONES[5]})
    rnd = random.Random(4)
    sub = spark.createDataFrame([(i, i % 7, rnd.uniform(0, 0.12), rnd.uniform(0, 0.12)) for i in range(400)] + [(400, 1, 9.0, 9.0)], "report_id long, citizen_id long, lon double, lat double")
    out, _ = govern.intake(sub, zones, spark.createDataFrame([(1, 5)], "citizen_id long, reports_count long"))
    rows = out.collect()
    given = {r["report_id"]: (r["lon"], r["lat"]) for r in sub.collect()}
    assert len(rows) == 401
    left = 0
    for r in rows:
        x, y = given[r["report_id"]]
        assert abs(r["lon"] - round(x / 0.001) * 0.001) <= 0.00051 and abs(r["lat"] - round(y / 0.001) * 0.001) <= 0.00051
        if r["zone_id"] is not None and not inside(ZONES[r["zone_id"]][1], r["lon"], r["lat"]):
            left += 1  # only where the snapped point lies too far outside
    assert left < 12
