"""Connected components by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.sources.scratch import Store


def connected_components(edges: DataFrame, store: Store, most_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node that links reach; nodes without links aren't listed.

    Large star: each node's larger neighbours are linked to the least of its neighbourhood. Small star: its
    smaller neighbours and itself are. Rounds go on until every node is linked to its component's least only;
    they are few, as distances halve. Each round is written to the shared folder, and the one before it goes.
    Neighbourhoods aren't gathered: a node's minimum is an aggregate with map-side combine, joined back. The
    result belongs to the store; links that don't settle in most_rounds raise. Null ends count as no link, a
    link to oneself says nothing, repeated links count once; no links give an empty result.
    """
    links = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    pairs = store.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    link = lambda x, y: F.struct(x.alias("u"), y.alias("v"))
    for _ in range(most_rounds):
        both = pairs.unionAll(pairs.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours go to the least of the neighbourhood, and so does the node itself.
        large = both.join(low, "u").select(F.when(v > u, link(v, m)).when(v == m, link(u, v)).alias("x"))
        large = store.cut(large.select("x.*").filter("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # Small star, on links u -> v with v < u: all of them and u to the least.
        small = large.join(low, "u").select(F.explode(F.array(link(v, m), link(u, m))).alias("x"))
        after = store.cut(small.select("x.*").filter("u <> v").distinct(), "small")
        store.drop(pairs, large)
        pairs = after
        # Stars only: no node is both a centre and a leaf, and each leaf has one centre.
        ends = pairs.select(F.explode(F.array(F.struct(u.alias("x"), F.lit(1).alias("leaf")), F.struct(v.alias("x"), F.lit(0).alias("leaf")))).alias("e")).select("e.*")
        if ends.groupBy("x").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("k")).filter("n > 1 OR (n > 0 AND k = 0)").isEmpty():
            return pairs.select(u.alias("node"), v.alias("component")).unionAll(pairs.select("v", "v").distinct())
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
