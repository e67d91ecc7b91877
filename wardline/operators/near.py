"""The nearest other point of each asking one, in cells that are as small as points are dense."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.sources.scratch import Store


def nearest_points(points: DataFrame, chosen: str, side: float, most: float, store: Store) -> DataFrame:
    """(id, near, d) of points (id, lat, lon): for each chosen one the other of the least squared distance d, of equal ones the least id, among those in its cell of `side` or next to it and no further than `most`.

    Cells start so small that the fullest of `side` has about a point in each, and grow fourfold. What lies within a
    cell's side is in the cell or next to it, so that a point found nearer than that is the nearest; only those who
    found none ask again, at last in cells of `side`. The result belongs to the store.
    """
    points = store.cut(points.select("id", "lat", "lon"), "points")
    at = lambda c, s: F.floor(F.col(c) / s)
    fullest = points.groupBy(at("lat", side), at("lon", side)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    asking = points.filter(chosen)
    around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)).alias(c)
    gap = F.pow(F.col("lat") - F.col("lat2"), 2) + F.pow(F.col("lon") - F.col("lon2"), 2)
    found = []
    for k in range(math.ceil(math.log(fullest, 16)), -1, -1):
        s = side / 4**k
        a = asking.select("id", "lat", "lon", at("lat", s).alias("gy"), at("lon", s).alias("gx"))
        a = a.select("id", "lat", "lon", around("gy"), "gx").select("id", "lat", "lon", "gy", around("gx"))
        b = points.select(F.col("id").alias("near"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), at("lat", s).alias("gy"), at("lon", s).alias("gx"))
        met = a.join(b, ["gy", "gx"]).withColumn("d", gap).filter((F.col("d") <= most) & (F.col("near") != F.col("id")))
        best = met.groupBy("id").agg(F.min(F.struct("d", "near")).alias("m")).select("id", "m.near", "m.d")
        # A little less than the side, for the last digits of cells' borders.
        best = store.cut(best.filter(F.col("d") < 0.99 * s * s) if k else best, "found")
        found.append(best)
        if k:
            asking = store.cut(asking.join(best, "id", "left_anti"), "asking")
            if asking.isEmpty():
                break
    return reduce(DataFrame.unionAll, found)
