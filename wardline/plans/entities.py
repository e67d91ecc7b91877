"""A typed graph of generated entities around incidents: each scenario's incidents in order, in clusters of twenty.

incidents (scenario, incident_id, label, and order columns); a scenario generates so many entities of each type for
each of its clusters. Places in a scenario's order are taken by ranges, so that no scenario meets in one task; what
lies next to each other is joined by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import hashing
from wardline.operators.ordered import running
from wardline.sources.scratch import Store

#: Incidents of a cluster, and what a person has to do with other entities.
CLUSTER = 20
RELATIONS = {"vehicle": "USED_VEHICLE", "phone": "USED_PHONE", "account": "CONTROLS"}
TYPES = ("person", *RELATIONS)


def placed(incidents: DataFrame, order: list[str], store: Store) -> DataFrame:
    """incidents with `place`, from 0 in each scenario, and `cluster`."""
    ranked = store.cut(running(incidents, [F.col("scenario"), *map(F.col, order)], {}, store, "_rank"), "ranked")
    first = ranked.groupBy("scenario").agg(F.min("_rank").alias("_first"))
    # As many rows as scenarios.
    rows = ranked.join(first, "scenario").withColumn("place", F.col("_rank") - F.col("_first")).drop("_rank", "_first")
    return store.cut(rows.withColumn("cluster", F.expr(f"place div {CLUSTER}")), "placed")


def _entity(kind: Column, ordinal: Column, cluster: Column | None = None) -> Column:
    return F.concat_ws(":", F.lit("entity"), "scenario", (F.col("cluster") if cluster is None else cluster).cast("string"), kind, ordinal.cast("string"))


def build(incidents: DataFrame, counts: DataFrame, order: list[str], store: Store) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes (id, type, scenario, label), edges (id, source, target, relation, support, weight, scenario).

    counts (scenario, person, vehicle, phone, account): entities of a cluster; person is 1 at least.
    """
    rows = placed(incidents, order, store)
    # A cluster for every twenty incidents.
    clusters = rows.select("scenario", "cluster").distinct().join(counts, "scenario")
    clusters = store.cut(clusters, "clusters")
    many = lambda kind: F.sequence(F.lit(0), F.col(kind) - 1)
    each = lambda kind: F.when(F.col(kind) > 0, F.transform(many(kind), lambda i: F.struct(F.lit(kind).alias("type"), i.cast("long").alias("ordinal")))).otherwise(F.array().cast("array<struct<type: string, ordinal: bigint>>"))
    made = clusters.select("scenario", "cluster", "person", F.explode(F.concat(*[each(k) for k in TYPES])).alias("e")).select("scenario", "cluster", "person", "e.type", "e.ordinal")
    made = made.withColumn("id", _entity(F.col("type"), F.col("ordinal")))
    incident = lambda c: F.concat(F.lit("incident:"), F.col(c).cast("string"))
    nodes = made.select("id", "type", "scenario", F.concat_ws(" ", "type", (F.col("cluster") + 1).cast("string"), (F.col("ordinal") + 1).cast("string")).alias("label"))
    nodes = nodes.unionByName(rows.select(incident("incident_id").alias("id"), F.lit("incident").alias("type"), "scenario", "label"))

    def edges(df: DataFrame, key: Column, source: Column, target: Column, relation: Column | str, support: str, weight: float) -> DataFrame:
        relation = F.lit(relation) if isinstance(relation, str) else relation
        return df.select(F.concat_ws(":", F.lit("edge"), "scenario", key).alias("id"), source.alias("source"), target.alias("target"), relation.alias("relation"), F.lit(support).alias("support"), F.lit(weight).alias("weight"), "scenario")

    relation = F.element_at(F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv]), F.col("type"))
    holds = made.filter("type <> 'person'").withColumn("by", F.explode(F.sequence(F.lit(0).cast("long"), F.col("person").cast("long") - 1)))
    said = lambda *c: F.concat_ws(":", *[x.cast("string") if isinstance(x, Column) else F.col(x).cast("string") for x in c])
    out = edges(holds, said("cluster", "type", "by", "ordinal"), _entity(F.lit("person"), F.col("by")), F.col("id"), relation, "generated_scenario", 0.8)
    # A cluster's first person and that of the one before.
    chained = clusters.filter("cluster > 0")
    out = out.unionByName(edges(chained, said("cluster", F.lit("bridge")), _entity(F.lit("person"), F.lit(0), F.col("cluster") - 1), _entity(F.lit("person"), F.lit(0)), "CO_ACCUSED_WITH", "generated_scenario", 0.7))
    who = F.pmod(hashing.stable_uint64("entity_graph_primary", F.col("incident_id").cast("string"), F.col("scenario")), F.col("person").cast("decimal(20,0)")).cast("long")
    accused = rows.join(counts.select("scenario", "person"), "scenario")
    out = out.unionByName(edges(accused, said(F.lit("incident"), "incident_id", F.lit("primary")), _entity(F.lit("person"), who), incident("incident_id"), "ACCUSED_IN", "generated_scenario", 1.0))
    before = rows.select("scenario", (F.col("place") + 1).alias("place"), F.col("incident_id").alias("before"))
    lag = rows.filter(f"place % {CLUSTER} > 0").join(before, ["scenario", "place"])
    return nodes, out.unionByName(edges(lag, said(F.lit("similarity"), "before", "incident_id"), incident("before"), incident("incident_id"), "SIMILAR_TO", "model_similarity", 0.65))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ends = edges.select("id", F.explode(F.array("source", "target")).alias("end"))
    return ends.join(nodes.select(F.col("id").alias("end")), "end", "left_anti")
