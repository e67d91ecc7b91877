"""Cells, distances and polygons as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The box of usable coordinates.
WEST, EAST, SOUTH, NORTH = 77.35, 77.85, 12.7, 13.2
#: Sides of cells in degrees by level: a square grid stands in for hexagons, which Spark lacks.
SIDES = {7: 0.02, 8: 0.008, 9: 0.003}


def usable(lat: Column, lon: Column) -> Column:
    """Finite, not zero and inside the box."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (lat != 0) & (lon != 0) & lat.between(SOUTH, NORTH) & lon.between(WEST, EAST), F.lit(False))


def cell(lat: Column, lon: Column, level: int = 9) -> Column:
    """level/row/column of the square that a point lies in."""
    side = SIDES[level]
    return F.concat_ws("/", F.lit(str(level)), F.floor(lat / side).cast("string"), F.floor(lon / side).cast("string"))


def centre(c: Column) -> Column:
    """struct<lat, lon> of a cell."""
    side = F.element_at(F.create_map(*[F.lit(x) for level, s in SIDES.items() for x in (str(level), s)]), F.element_at(F.split(c, "/"), 1))
    at = lambda i: (F.element_at(F.split(c, "/"), i).cast("double") + 0.5) * side
    return F.struct(at(2).alias("lat"), at(3).alias("lon"))


def inside(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point lies in a polygon: crossings of a ray with all rings (outer ones and holes), counted odd. rings: array<array<struct<x, y>>>."""

    def crossings(ring: Column) -> Column:
        edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
        cross = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
        return F.size(F.filter(edges, lambda e: F.coalesce(cross(e), F.lit(False))))

    return F.aggregate(rings, F.lit(0), lambda acc, ring: acc + crossings(ring)) % 2 == 1


def beside(x: Column, y: Column, rings: Column, most: float = 1e-11) -> Column:
    """Whether a point lies on the line of an edge, up to the last digits of doubles: cross products are `most` at most, in squared degrees."""
    edges = lambda ring: F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
    near = lambda e: F.abs((e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])) <= most
    return F.exists(rings, lambda ring: F.exists(edges(ring), near))


def area(ring: Column) -> Column:
    """The area of a closed ring in squared units."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def densified(ring: Column, step: float) -> Column:
    """The ring with points put in, so that none is further than step from the next in either coordinate."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))

    def points(e: Column) -> Column:
        n = F.greatest(F.ceil(F.greatest(F.abs(e["b"]["x"] - e["a"]["x"]), F.abs(e["b"]["y"] - e["a"]["y"])) / step), F.lit(1)).cast("int")
        at = lambda c, i: e["a"][c] + (e["b"][c] - e["a"][c]) * i / n
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at("x", i).alias("x"), at("y", i).alias("y")))

    return F.concat(F.flatten(F.transform(edges, points)), F.array(F.element_at(ring, -1)))
