"""Points in polygon zones, by a cover of grid cells.

Each polygon is cut into square cells once. A cell that lies inside is kept as large as it can be, so a city-wide zone stays a few
rows; a cell that the border crosses is halved down to the finest size and then carries only the pieces of the border in it, and whether
a fixed place near its centre lies inside. A point looks up its cell of each size with one equi-join: inside cells need no geometry, and in
a border cell the way from that place to the point, first along the meridian and then along the parallel, changes sides at every piece it
crosses.

Containment is the even-odd rule over all rings of a zone, so a first ring may have holes and further islands. A border point
belongs to the side that lies to its upper right, which gives every point of a gapless division exactly one zone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Finest cell in degrees, and how often cells are doubled: 0.005 to 0.32 degrees.
FINEST, DOUBLINGS = 0.005, 6
#: Pieces of the border this close to a cell, in cell sizes, belong to it too, so that rounding loses none.
MARGIN = 1e-6
#: The place within a cell from which ways start; odd fractions, so that borders drawn on a grid do not run through it.
PLACE = (0.4871263915, 0.5349177283)
PIECES = "pieces:array<struct<x1:double,y1:double,x2:double,y2:double>>"
RINGS = "array<array<struct<lon:double,lat:double>>>"


def rings(vertices: DataFrame, keys: Sequence[str] = ("zone_id",), ring: str = "ring", order: str = "k") -> DataFrame:
    """``(*keys, rings)`` from one row per vertex; ring 0 is the outline, the others are holes or islands."""
    one = vertices.groupBy(*keys, ring).agg(F.sort_array(F.collect_list(F.struct(order, "lon", "lat"))).alias("v"))
    one = one.select(*keys, ring, F.transform("v", lambda p: F.struct(p["lon"].cast("double").alias("lon"), p["lat"].cast("double").alias("lat"))).alias("v"))
    return one.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(ring, "v"))).alias("r")).select(*keys, F.transform("r", lambda x: x["v"]).alias("rings"))


def box_rings(lon_c: Column, lat_c: Column, half: Column) -> Column:
    """A square as rings."""
    at = lambda x, y: F.struct((lon_c + x * half).alias("lon"), (lat_c + y * half).alias("lat"))
    return F.array(F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1)))


def _edges(polygon) -> np.ndarray:
    """Border pieces ``(x1, y1, x2, y2)`` of all rings."""
    out = [np.zeros((0, 4))]
    for ring in polygon or ():
        p = np.array([(v["lon"], v["lat"]) for v in ring], float).reshape(-1, 2)
        if len(p) > 1 and (p[0] == p[-1]).all():
            p = p[:-1]
        if len(p) > 2:
            out.append(np.hstack([p, np.roll(p, -1, axis=0)]))
    return np.vstack(out)


def area(polygon) -> float:
    """The outline's area less that of the other rings, in square degrees."""
    total = 0.0
    for i, ring in enumerate(polygon or ()):
        e = _edges([ring])
        total += (1 if i == 0 else -1) * abs(float((e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]).sum()) / 2)
    return total


def _right_of(e: np.ndarray, x: float, y: float) -> bool:
    """Whether an odd number of pieces crosses the parallel of a point to its right."""
    c = e[(e[:, 1] > y) != (e[:, 3] > y)]
    return bool((x < c[:, 0] + (y - c[:, 1]) * (c[:, 2] - c[:, 0]) / (c[:, 3] - c[:, 1])).sum() % 2)


def _way(e: np.ndarray, a: tuple[float, float], b: tuple[float, float]) -> bool:
    """Whether the way from ``a`` along its meridian and then along the parallel of ``b`` changes sides."""
    v = e[(e[:, 0] > a[0]) != (e[:, 2] > a[0])]
    y = v[:, 1] + (a[0] - v[:, 0]) * (v[:, 3] - v[:, 1]) / (v[:, 2] - v[:, 0])
    h = e[(e[:, 1] > b[1]) != (e[:, 3] > b[1])]
    x = h[:, 0] + (b[1] - h[:, 1]) * (h[:, 2] - h[:, 0]) / (h[:, 3] - h[:, 1])
    return bool((((y > a[1]) != (y > b[1])).sum() + ((x > a[0]) != (x > b[0])).sum()) % 2)


def _touching(e: np.ndarray, x0: float, y0: float, size: float) -> np.ndarray:
    """The pieces that come near the cell: their boxes meet, and the cell's corners do not all lie clearly on one side of their line."""
    m = size * MARGIN
    x0, y0, x1, y1 = x0 - m, y0 - m, x0 + size + m, y0 + size + m
    e = e[(np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 0], e[:, 2]) >= x0) & (np.minimum(e[:, 1], e[:, 3]) <= y1) & (np.maximum(e[:, 1], e[:, 3]) >= y0)]
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    side = np.stack([dx * (y - e[:, 1]) - dy * (x - e[:, 0]) for x in (x0, x1) for y in (y0, y1)])
    return e[(side.min(axis=0) <= 0) & (side.max(axis=0) >= 0)]


def _place(cx: int, cy: int, size: float) -> tuple[float, float]:
    return (cx + PLACE[0]) * size, (cy + PLACE[1]) * size


def cells(polygon, finest: float = FINEST, doublings: int = DOUBLINGS) -> list[tuple[int, int, int, bool, np.ndarray | None]]:
    """The cover of one polygon: level, cell numbers, centre inside, border pieces (``None`` where the whole cell lies inside)."""
    e, out = _edges(polygon), []
    if not len(e):
        return out
    size = finest * 2 ** doublings
    lo = np.floor(np.minimum(e[:, :2].min(axis=0), e[:, 2:].min(axis=0)) / size).astype(int)
    hi = np.floor(np.maximum(e[:, :2].max(axis=0), e[:, 2:].max(axis=0)) / size).astype(int)
    todo = []
    for cx in range(lo[0], hi[0] + 1):
        for cy in range(lo[1], hi[1] + 1):
            centre = _place(cx, cy, size)
            todo.append((doublings, cx, cy, _right_of(e, *centre), _touching(e, cx * size, cy * size, size)))
    while todo:
        level, cx, cy, inside, mine = todo.pop()
        if not len(mine):
            if inside:
                out.append((level, cx, cy, True, None))
            continue
        if level == 0:
            out.append((0, cx, cy, inside, mine))
            continue
        size, half = finest * 2 ** level, finest * 2 ** (level - 1)
        centre = _place(cx, cy, size)
        for sx in (2 * cx, 2 * cx + 1):
            for sy in (2 * cy, 2 * cy + 1):
                to = _place(sx, sy, half)
                todo.append((level - 1, sx, sy, inside != _way(mine, centre, to), _touching(mine, sx * half, sy * half, half)))
    return out


def cover(zones: DataFrame, finest: float = FINEST, doublings: int = DOUBLINGS) -> DataFrame:
    """``(level, cx, cy, z)`` for ``zones(zone_id, niveau, rings)``; ``z`` has zone_id, niveau, area, centre inside and border pieces.

    Zones are cut side by side; one zone's work and memory depend on its own border only.
    """
    kind = zones.schema["zone_id"].dataType.simpleString()

    z = zones.select("zone_id", F.col("niveau").cast("int").alias("niveau"), F.col("rings").cast(RINGS).alias("rings"))
    def run(batches):
        for b in batches:
            piece = pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]))
            schema = pa.schema([("level", pa.int32()), ("cx", pa.int64()), ("cy", pa.int64()), ("z", pa.struct([
                ("zone_id", b.schema.field("zone_id").type), ("niveau", pa.int32()), ("area", pa.float64()), ("centre", pa.bool_()), ("pieces", piece)]))])
            for row in b.to_pylist():
                size = area(row["rings"])
                rows = [{"level": level, "cx": cx, "cy": cy, "z": {"zone_id": row["zone_id"], "niveau": row["niveau"], "area": size, "centre": inside, "pieces":
                         None if e is None else [dict(zip(("x1", "y1", "x2", "y2"), p)) for p in e.tolist()]}} for level, cx, cy, inside, e in cells(row["rings"], finest, doublings)]
                for i in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_pylist(rows[i:i + 2000], schema=schema)

    return spread(z, "zone_id").mapInArrow(run, f"level int, cx long, cy long, z struct<zone_id:{kind},niveau:int,area:double,centre:boolean,{PIECES}>")


def _odd(pieces: Column, from_x: Column, from_y: Column, x: Column, y: Column) -> Column:
    """Whether the way from the centre to the point crosses an odd number of pieces."""
    def crossed(p):
        up = p["y1"] + (from_x - p["x1"]) * (p["y2"] - p["y1"]) / F.nullif(p["x2"] - p["x1"], F.lit(0.0))
        along = p["x1"] + (y - p["y1"]) * (p["x2"] - p["x1"]) / F.nullif(p["y2"] - p["y1"], F.lit(0.0))
        v = F.when((p["x1"] > from_x) != (p["x2"] > from_x), ((up > from_y) != (up > y)).cast("int")).otherwise(0)
        h = F.when((p["y1"] > y) != (p["y2"] > y), ((along > from_x) != (along > x)).cast("int")).otherwise(0)
        return v + h

    return F.aggregate(pieces, F.lit(0), lambda n, p: n + crossed(p)) % 2 == 1


def containing(points: DataFrame, zones: DataFrame, lon: str = "lon", lat: str = "lat", finest: float = FINEST, doublings: int = DOUBLINGS) -> DataFrame:
    """Each point with the array ``zones`` of ``(zone_id, niveau, area)`` of all zones around it, null if there is none.

    ``points`` must not have a column ``zones``; null positions lie nowhere. Each distinct position meets its cell of each size, the
    zones of a cell in one array; rows at one position share what was found there.
    """
    cov = cover(zones, finest, doublings).groupBy("level", "cx", "cy").agg(F.collect_list("z").alias("_z"))
    at = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(lon).alias("_x"), F.col(lat).alias("_y")).distinct()
    size = F.lit(finest) * F.pow(F.lit(2.0), F.col("level"))
    hit = at.select("_x", "_y", F.explode(F.sequence(F.lit(0), F.lit(doublings))).alias("level"))
    hit = hit.withColumns({"cx": F.floor(F.col("_x") / size).cast("long"), "cy": F.floor(F.col("_y") / size).cast("long")})
    hit = hit.join(cov, ["level", "cx", "cy"])
    # only cells of the finest size have pieces
    centre = [(F.col(c) + at) * F.lit(finest) for c, at in zip(("cx", "cy"), PLACE)]
    in_cell = F.filter("_z", lambda z: F.when(z["pieces"].isNull(), z["centre"]).otherwise(z["centre"] != _odd(z["pieces"], *centre, F.col("_x"), F.col("_y"))))
    one = hit.select("_x", "_y", F.transform(in_cell, lambda z: F.struct(z["zone_id"].alias("zone_id"), z["niveau"].alias("niveau"), z["area"].alias("area"))).alias("z"))
    found = one.where(F.size("z") > 0).groupBy("_x", "_y").agg(F.array_sort(F.flatten(F.collect_list("z"))).alias("zones"))
    return points.join(found, (F.col(lon) == F.col("_x")) & (F.col(lat) == F.col("_y")), "left").drop("_x", "_y")


def smallest(zones: Column, niveau: int | None = 3) -> Column:
    """The id of the zone with the least area, of the given level only; of equally small ones the least id."""
    z = zones if niveau is None else F.filter(zones, lambda s: s["niveau"] == niveau)
    return F.array_min(F.transform(z, lambda s: F.struct(s["area"].alias("a"), s["zone_id"].alias("zone_id"))))["zone_id"]


def deepest(zones: Column) -> Column:
    """The id of the zone with the highest level, of several the least id."""
    return F.array_min(F.transform(zones, lambda s: F.struct((-s["niveau"]).alias("a"), s["zone_id"].alias("zone_id"))))["zone_id"]
