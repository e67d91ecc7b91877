"""Regions that a routing table is made for, and whether one holds: seeds grown by neighbours to a cover, and sampled pairs of cells.

seeds (region, tier, buffer, anchor), a row for each anchor; areas (code, rings); near (a, b) pairs of adjacent areas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import hashing, hexes
from wardline.functions.scalars import haversine_km, half_up
from wardline.operators.ordered import running
from wardline.operators.relational import nearest_rank
from wardline.sources.scratch import Store

#: Errors in percent that a table's median and largest stay below.
MEDIAN_GATE, MAX_GATE = 5.0, 20.0


def plan(seeds: DataFrame, areas: DataFrame, near: DataFrame) -> DataFrame:
    """(region, tier, buffer, code): each seed's anchors with their neighbours, and a region of its own for every area that no regional seed has as an anchor."""
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    grown = seeds.join(both, F.col("anchor") == F.col("a")).select("region", "tier", "buffer", F.col("b").alias("code"))
    own = seeds.select("region", "tier", "buffer", F.col("anchor").alias("code"))
    alone = areas.select("code").join(seeds.filter("tier = 'regional'").select(F.col("anchor").alias("code")), "code", "left_anti")
    local = alone.select(F.concat(F.lit("local_"), F.col("code").cast("string")).alias("region"), F.lit("local").alias("tier"), F.lit(0).alias("buffer"), "code")
    return own.unionByName(grown).distinct().unionByName(local)


def uncovered(regions: DataFrame, areas: DataFrame) -> DataFrame:
    """Areas that no region has."""
    return areas.select("code").join(regions, "code", "left_anti")


def cells(regions: DataFrame, areas: DataFrame, level: int, store: Store) -> DataFrame:
    """(region, number, cell, code): cells of a region's areas and those so many rings around; code where a cell is an area's own."""
    cover = store.cut(hexes.cover(areas, "rings", level, "code"), "cover")
    core = regions.select("region", "code", "buffer").join(cover, "code")
    rings = core.select("region", F.explode(F.when(F.col("buffer") > 0, hexes.disk(F.col("cell"), 2)).otherwise(F.array("cell"))).alias("cell")).distinct()
    owner = core.groupBy("region", "cell").agg(F.min("code").alias("code"))
    rows = rings.join(owner, ["region", "cell"], "left")
    ranked = store.cut(running(rows, [F.col("region"), F.col("cell")], {}, store, "_rank"), "cells")
    first = ranked.groupBy("region").agg(F.min("_rank").alias("_first"))
    return store.cut(ranked.join(first, "region").select("region", (F.col("_rank") - F.col("_first")).alias("number"), "cell", "code"), "numbered")


def sample(sizes: DataFrame, most: int, store: Store) -> DataFrame:
    """(region, from, to): the first `most` pairs of different numbers below n that draws of the region's probes hit, or all there are; sizes (region, n)."""
    probes = 4 * most
    while True:
        drawn = sizes.select("region", "n", F.explode(F.sequence(F.lit(0), F.lit(probes - 1))).alias("probe"))
        draw = lambda end: F.pmod(hashing.stable_uint64("routing_validation", F.col("region"), F.concat(F.lit(f"{end}:"), F.col("probe").cast("string"))), F.col("n").cast("decimal(20,0)")).cast("long")
        pairs = drawn.select("region", "n", "probe", draw("from").alias("from"), draw("to").alias("to")).filter("from <> to")
        firsts = pairs.groupBy("region", "n", "from", "to").agg(F.min("probe").alias("probe"))
        # A region has 4 * most probes or a few times as many: its pairs are bounded.
        taken = firsts.groupBy("region", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct("probe", "from", "to"))), 1, most).alias("pairs"))
        taken = store.cut(sizes.join(taken, ["region", "n"], "left"), "pairs")
        short = F.coalesce(F.size("pairs"), F.lit(0)) < F.least(F.lit(most), F.col("n") * (F.col("n") - 1))
        if taken.filter(short).isEmpty():
            return taken.select("region", F.explode("pairs").alias("p")).select("region", "p.from", "p.to")
        probes *= 2


def validation(numbered: DataFrame, most: int, store: Store, km_per_hour: float = 30.0) -> DataFrame:
    """region, cells, samples, quartiles of seconds, median and largest error in percent, pairs that cross a boundary, status.

    The table's seconds are those between centres of cells, as a table of floats keeps them; what they are held
    to are those between centres to three places of a degree: distance over speed stands in for a road network.
    """
    at = hexes.centre(F.col("cell"))
    spots = store.cut(numbered.select("region", "number", "code", at["lat"].alias("lat"), at["lon"].alias("lon")), "spots")
    pairs = sample(numbered.groupBy("region").agg(F.count("*").alias("n")), most, store)
    end = lambda e: spots.select("region", F.col("number").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in ("code", "lat", "lon")])
    both = pairs.join(end("from"), ["region", "from"]).join(end("to"), ["region", "to"])
    seconds = lambda f: haversine_km(*[f(F.col(c)) for c in ("lat_from", "lon_from", "lat_to", "lon_to")]) / km_per_hour * 3600
    both = both.withColumn("seconds", seconds(lambda c: c).cast("float").cast("double")).withColumn("live", seconds(lambda c: half_up(c, 3)))
    both = both.withColumn("error", F.when(F.col("live") > 0, 100 * F.abs(F.col("seconds") - F.col("live")) / F.col("live")).otherwise(0.0))
    crosses = F.col("code_from").isNotNull() & F.col("code_to").isNotNull() & (F.col("code_from") != F.col("code_to"))
    both = store.cut(both.select("region", "seconds", "error", crosses.alias("crosses")), "checked")
    out = both.groupBy("region").agg(F.count("*").alias("samples"), F.median("error").alias("median_error"), F.max("error").alias("max_error"), F.count_if("crosses").alias("cross_boundary"))
    for f, name in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3")):
        out = out.join(nearest_rank(both, ["region"], "seconds", f, name), "region")
    out = numbered.groupBy("region").agg(F.count("*").alias("cells")).join(out, "region")
    return out.withColumn("status", F.when((F.col("median_error") < MEDIAN_GATE) & (F.col("max_error") < MAX_GATE), "PASS").otherwise("FAIL"))
