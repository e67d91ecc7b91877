"""Hexagonal cells as Column expressions: a lattice of pointy hexagons on a local plane, named level/q/r in axial coordinates.

The plane is kilometres east and north of the box's corner, true along its middle latitude. Cells of one level tile
the plane; those of different levels don't nest, as with other hexagonal grids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.geo import NORTH, SOUTH, WEST, inside

#: Edges of cells in kilometres by level.
EDGES_KM = {7: 1.22, 8: 0.461, 9: 0.174}
#: Kilometres of a degree of latitude, and of one of longitude on the middle latitude.
KM_NORTH = 6371.0088 * math.pi / 180
KM_EAST = KM_NORTH * math.cos(math.radians((SOUTH + NORTH) / 2))
ROOT3 = math.sqrt(3)


def _plane(lat: Column, lon: Column) -> tuple[Column, Column]:
    return (lon - WEST) * KM_EAST, (lat - SOUTH) * KM_NORTH


def axial(lat: Column, lon: Column, level: int) -> tuple[Column, Column]:
    """q and r of the cell that a point lies in: cube coordinates rounded, the worst of the three made up from the others."""
    x, y = _plane(lat, lon)
    size = EDGES_KM[level]
    a, c = (x * ROOT3 - y) / (3 * size), y * 2 / (3 * size)
    b = -a - c
    ra, rb, rc = (F.floor(v + 0.5) for v in (a, b, c))
    da, db, dc = F.abs(ra - a), F.abs(rb - b), F.abs(rc - c)
    worst_a, worst_c = (da > db) & (da > dc), ~((da > db) & (da > dc)) & (db <= dc)
    return F.when(worst_a, -rb - rc).otherwise(ra), F.when(worst_c, -ra - rb).otherwise(rc)


def name(level: int, q: Column, r: Column) -> Column:
    return F.concat_ws("/", F.lit(f"h{level}"), q.cast("string"), r.cast("string"))


def cell(lat: Column, lon: Column, level: int = 9) -> Column:
    """The name of the cell that a point lies in; null where it has no coordinates."""
    return F.when(lat.isNotNull() & lon.isNotNull(), name(level, *axial(lat, lon, level)))


def level_of(c: Column) -> Column:
    return F.substring(F.element_at(F.split(c, "/"), 1), 2, 2).cast("int")


def centre(c: Column) -> Column:
    """struct<lat, lon> of a cell."""
    size = F.element_at(F.create_map(*[F.lit(x) for pair in EDGES_KM.items() for x in pair]), level_of(c))
    q, r = (F.element_at(F.split(c, "/"), i).cast("double") for i in (2, 3))
    return F.struct((F.lit(SOUTH) + size * 1.5 * r / KM_NORTH).alias("lat"), (F.lit(WEST) + size * ROOT3 * (q + r / 2) / KM_EAST).alias("lon"))


def disk(c: Column, k: int) -> Column:
    """The cells at most k steps from a cell, itself first."""
    parts = F.split(c, "/")
    steps = sorted(((q, r) for q in range(-k, k + 1) for r in range(-k, k + 1) if abs(q + r) <= k), key=lambda s: (max(abs(s[0]), abs(s[1]), abs(sum(s))), s))
    at = lambda i, step: (F.element_at(parts, i).cast("long") + step).cast("string")
    return F.array(*[F.concat_ws("/", F.element_at(parts, 1), at(2, q), at(3, r)) for q, r in steps])


def cover(areas: DataFrame, rings: str, level: int, *keys: str) -> DataFrame:
    """keys..., cell: the cells whose centres lie in an area. Each row of the lattice that crosses the area's box is walked by itself."""
    size = EDGES_KM[level]
    points = F.flatten(F.col(rings))
    ends = lambda f, axis: f(F.transform(points, lambda p: p[axis]))
    box = areas.select(*keys, rings, *[ends(f, axis).alias(n) for n, f, axis in (("_x0", F.array_min, "x"), ("_x1", F.array_max, "x"), ("_y0", F.array_min, "y"), ("_y1", F.array_max, "y"))])
    up = lambda c: (F.col(c) - SOUTH) * KM_NORTH / (1.5 * size)
    rows = box.withColumn("_r", F.explode(F.sequence(F.ceil(up("_y0")), F.floor(up("_y1")))))
    across = lambda c: (F.col(c) - WEST) * KM_EAST / (size * ROOT3) - F.col("_r") / 2
    first, last = F.ceil(across("_x0")), F.floor(across("_x1"))
    cells = rows.withColumn("_q", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))))
    cells = cells.withColumn("cell", name(level, F.col("_q"), F.col("_r"))).withColumn("_at", centre(F.col("cell")))
    return cells.filter(inside(F.col("_at.lon"), F.col("_at.lat"), F.col(rings))).select(*keys, "cell")


def buffered(cells: DataFrame, k: int, *keys: str) -> DataFrame:
    """keys..., cell: the cells within k steps of those of each key; without keys, of their union."""
    return cells.select(*keys, F.explode(disk(F.col("cell"), k)).alias("cell")).distinct()
