"""Where an incident took place, and how that is known: its own coordinate, a neighbour's, or an anchor of its territory.

In order, for an incident (incident_id, code, premise, lat, lon):
1. its territory has no area: a usable coordinate is `reported`, unverified; otherwise it is `unlocatable`;
2. the coordinate lies in its own area: `reported`, verified;
3. it lies in an adjacent area: `reported_corrected`, verified;
4. else it is `inferred` from an anchor, drawn by id and premise out of the pool of its territory and premise, or,
   if that is empty, out of all of its territory's; without any anchor it is `unlocatable`.

Pools are numbered by ranges, none in one task, and drawn anchors are joined on territory, pool and number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import geo, hashing
from wardline.operators.boundaries import adjacency, containing
from wardline.operators.ordered import running
from wardline.sources.scratch import Store


def numbered(rows: DataFrame, keys: list[str], order: str, store: Store) -> DataFrame:
    """rows with `number`, from 0 in each pool, and `pool`, its size."""
    ranked = running(rows, [*map(F.col, keys), F.col(order)], {}, store, "_rank")
    pools = ranked.groupBy(*keys).agg(F.min("_rank").alias("_first"), F.count("*").alias("pool"))
    return ranked.join(pools, keys).withColumn("number", F.col("_rank") - F.col("_first")).drop("_rank", "_first")


def anchor_pools(anchors: DataFrame, store: Store) -> DataFrame:
    """(code, kind, anchor_id, lat, lon) -> the same with number and pool, once by kind and once as kind '*' for all of a territory."""
    both = anchors.unionByName(anchors.withColumn("kind", F.lit("*")))
    return store.cut(numbered(both, ["code", "kind"], "anchor_id", store), "pools")


def resolve(incidents: DataFrame, areas: DataFrame, anchors: DataFrame, store: Store, near: DataFrame | None = None, border: Column | None = None) -> DataFrame:
    """incident_id, code, premise, origin, method, lat, lon, anchor_id, polygon_verified, pin_eligible: a row for each incident. near: (a, b) pairs of adjacent areas, made if not given; border: as `containing` takes it."""
    near = store.cut(adjacency(areas) if near is None else near, "near")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    usable = geo.usable(F.col("lat"), F.col("lon"))
    rows = store.cut(incidents.select("incident_id", "code", "premise", F.when(usable, F.col("lat")).alias("lat"), F.when(usable, F.col("lon")).alias("lon")), "incidents")
    hits = containing(rows.filter("lat IS NOT NULL").select(F.col("incident_id").alias("id"), "lat", "lon"), areas, border=border)
    # Areas may overlap: the own one counts first, else that of the least code.
    lies = hits.withColumnRenamed("code", "there").join(rows.select(F.col("incident_id").alias("id"), "code"), "id")
    lies = lies.groupBy(F.col("id").alias("incident_id"), "code").agg(F.bool_or(F.col("there") == F.col("code")).alias("own"), F.min("there").alias("there"))
    lies = lies.join(both.select(F.col("a").alias("code"), F.col("b").alias("there"), F.lit(True).alias("beside")), ["code", "there"], "left").drop("code", "there")
    known = areas.select("code", F.lit(True).alias("has_area"))
    rows = rows.join(known, "code", "left").join(lies, "incident_id", "left")
    own, beside, placed = (F.coalesce(c, F.lit(False)) for c in ("own", "beside", F.col("lat").isNotNull()))
    state = F.when(F.col("has_area").isNull(), F.when(placed, "source_coordinate_unverified").otherwise("no_polygon_no_coordinate"))
    state = state.when(own, "source_coordinate_in_assigned_polygon").when(beside, "source_coordinate_in_adjacent_polygon").otherwise("geo_anchor_v1")
    rows = store.cut(rows.withColumn("method", state).drop("has_area", "own", "beside"), "states")

    pools = anchor_pools(anchors, store)
    sizes = pools.select("code", "kind", "pool").distinct()
    asking = rows.filter("method = 'geo_anchor_v1'").select("incident_id", "code", "premise")
    asking = asking.join(sizes.select("code", F.col("kind").alias("premise"), F.col("pool").alias("own_pool")), ["code", "premise"], "left")
    asking = asking.join(sizes.filter("kind = '*'").select("code", F.col("pool").alias("all_pool")), "code", "left")
    n = F.coalesce("own_pool", "all_pool")
    draw = F.pmod(hashing.stable_uint64("geo_resolve", F.col("incident_id").cast("string"), F.col("premise")), n.cast("decimal(20,0)")).cast("long")
    asking = asking.select("incident_id", "code", F.when(F.col("own_pool").isNotNull(), F.col("premise")).otherwise("*").alias("kind"), draw.alias("number"))
    found = asking.join(pools.select("code", "kind", "number", "anchor_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), ["code", "kind", "number"]).select("incident_id", "anchor_id", "lat2", "lon2")

    rows = rows.join(found, "incident_id", "left")
    inferred = F.col("method") == "geo_anchor_v1"
    method = F.when(inferred & F.col("anchor_id").isNull(), "no_anchor_available").otherwise(F.col("method"))
    rows = rows.withColumn("method", method)
    origin = F.when(F.col("method").isin("source_coordinate_unverified", "source_coordinate_in_assigned_polygon"), "reported").when(F.col("method") == "source_coordinate_in_adjacent_polygon", "reported_corrected").when(F.col("method") == "geo_anchor_v1", "inferred").otherwise("unlocatable")
    rows = rows.withColumn("origin", origin)
    at = lambda own, anchor: F.when(F.col("origin") == "inferred", F.col(anchor)).when(F.col("origin") != "unlocatable", F.col(own))
    return rows.select(
        "incident_id", "code", "premise", "origin", "method", at("lat", "lat2").alias("lat"), at("lon", "lon2").alias("lon"), "anchor_id",
        F.col("method").isin("source_coordinate_in_assigned_polygon", "source_coordinate_in_adjacent_polygon").alias("polygon_verified"),
        F.col("origin").isin("reported", "reported_corrected").alias("pin_eligible"),
    )
