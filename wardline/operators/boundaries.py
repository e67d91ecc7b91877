"""Areas that meet: adjacency by claims of grid cells, distances of boundaries, and which area a point lies in.

Areas are (code, rings), rings array<array<struct<x, y>>> of closed rings in degrees. Nothing compares all areas
with each other: boundaries and points meet in the cells of a grid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.geo import beside, inside
from wardline.functions.scalars import haversine_km

#: Steps of points along an edge and sides of the cells that they claim, in degrees.
STEP, GRID = 0.00036, 0.0005
_KM_A_DEGREE = 6371.0088 * math.pi / 180


def along(ring: Column, step: float) -> Column:
    """Points along a ring: each edge's start, and as many more as whole steps fit into it."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))

    def points(e: Column) -> Column:
        span = F.greatest(F.abs(e["b"]["x"] - e["a"]["x"]), F.abs(e["b"]["y"] - e["a"]["y"]))
        n = F.greatest(F.floor(span / step), F.lit(1)).cast("int")
        at = lambda c, i: e["a"][c] + (e["b"][c] - e["a"][c]) * i / n
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at("x", i).alias("x"), at("y", i).alias("y")))

    return F.flatten(F.transform(edges, points))


def boundary(areas: DataFrame, step: float) -> DataFrame:
    """code, x, y: points along all rings."""
    return areas.select("code", F.explode("rings").alias("ring")).select("code", F.explode(along(F.col("ring"), step)).alias("p")).select("code", "p.x", "p.y")


def _around(c: Column) -> Column:
    return F.explode(F.array(c - 1, c, c + 1))


def adjacency(areas: DataFrame, step: float = STEP, grid: float = GRID) -> DataFrame:
    """(a, b), a < b: areas whose boundaries claim a cell together; each point claims its cell and the eight around."""
    cells = boundary(areas, step).select("code", F.floor(F.col("x") / grid).alias("gx"), F.floor(F.col("y") / grid).alias("gy")).distinct()
    claims = cells.select("code", _around(F.col("gx")).alias("gx"), "gy").select("code", "gx", _around(F.col("gy")).alias("gy")).distinct()
    other = claims.select(F.col("code").alias("b"), "gx", "gy")
    return claims.withColumnRenamed("code", "a").join(other, ["gx", "gy"]).filter("a < b").select("a", "b").distinct()


def distances(points: DataFrame, cutoff_km: float, most_lat: float = 60.0) -> DataFrame:
    """(a, b, km), a < b: the least distance of points (code, x, y) of two areas, where it is cutoff_km at most.

    Cells are as wide as the cutoff (at most_lat, where degrees of longitude are shortest), so that near points lie in the same cell or next to it.
    """
    high, wide = cutoff_km / _KM_A_DEGREE, cutoff_km / (_KM_A_DEGREE * math.cos(math.radians(most_lat)))
    at = points.select("code", "x", "y", F.floor(F.col("x") / wide).alias("gx"), F.floor(F.col("y") / high).alias("gy"))
    near = at.select(F.col("code").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), _around(F.col("gx")).alias("gx"), "gy")
    near = near.select("b", "x2", "y2", "gx", _around(F.col("gy")).alias("gy"))
    km = haversine_km(F.col("y"), F.col("x"), F.col("y2"), F.col("x2"))
    both = at.withColumnRenamed("code", "a").join(near, ["gx", "gy"]).filter("a < b").groupBy("a", "b").agg(F.min(km).alias("km"))
    return both.filter(F.col("km") <= cutoff_km)


def containing(points: DataFrame, areas: DataFrame, grid: float = 0.05, border: Column | None = None) -> DataFrame:
    """(id, code): the areas that points (id, lat, lon) lie in. An area goes to the cells that its box touches.

    On the line of an edge, rounding decides which side a point is on. Where areas are made by a rule of their own, `border`
    is that rule, of lon, lat and further columns of areas; it says for points on such a line whether they lie inside.
    """
    corner = lambda f, axis: F.floor(f(F.transform(F.flatten("rings"), lambda p: p[axis])) / grid)
    spread = areas.select("*", F.explode(F.sequence(corner(F.array_min, "x"), corner(F.array_max, "x"))).alias("gx"))
    spread = spread.select("*", F.explode(F.sequence(corner(F.array_min, "y"), corner(F.array_max, "y"))).alias("gy"))
    at = points.select("id", "lat", "lon", F.floor(F.col("lon") / grid).alias("gx"), F.floor(F.col("lat") / grid).alias("gy"))
    here = (F.col("lon"), F.col("lat"), F.col("rings"))
    lies = inside(*here) if border is None else F.when(beside(*here), border).otherwise(inside(*here))
    return at.join(spread, ["gx", "gy"]).filter(lies).select("id", "code")
