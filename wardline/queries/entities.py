"""The entity graph of incidents, a scenario for each head, and the hours of their kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalogue import INCIDENTS, _hmac, query
from wardline.functions.scalars import half_up
from wardline.plans import entities, hours
from wardline.sources.scratch import Store
from wardline.sources.tables import incidents, table

#: Entities of a cluster by scenario: people, vehicles, phones, accounts.
_COUNTS = {"1-URGENT": (1, 2, 1, 0), "2-HIGH": (1, 0, 1, 4), "3-MEDIUM": (2, 0, 1, 0), "4-NOT SPECIFIED": (1, 2, 0, 0), "5-LOW": (2, 0, 1, 1)}
_ORDER = ["station", "registered_on", "incident_id"]
_BASE = (
    INCIDENTS
    + f""", k(scenario, person, vehicle, phone, account) AS (VALUES {", ".join(f"('{s}', {', '.join(map(str, c))})" for s, c in _COUNTS.items())}),
    r AS (SELECT head AS scenario, incident_id, row_number() OVER (PARTITION BY head ORDER BY station, registered_on, incident_id) - 1 AS place FROM inc), p AS (SELECT *, place // 20 AS c FROM r),
    cl AS (SELECT DISTINCT scenario, c FROM p), t(kind, rel) AS (VALUES ('person', NULL), ('vehicle', 'USED_VEHICLE'), ('phone', 'USED_PHONE'), ('account', 'CONTROLS')),
    m AS (SELECT scenario, c, person, kind, rel, unnest(range(0, CASE kind WHEN 'person' THEN person WHEN 'vehicle' THEN vehicle WHEN 'phone' THEN phone ELSE account END)) AS o FROM cl JOIN k USING (scenario), t),
    e AS (SELECT *, 'entity:' || scenario || ':' || c || ':' || kind || ':' || o AS id FROM m)
"""
)
_WHO = f"CAST(CAST('0x' || substr({_hmac("'1|entity_graph_primary|' || incident_id || '|' || scenario")}, 1, 16) AS UBIGINT) % person AS BIGINT)"


def _graph(spark: SparkSession, d: str, store: Store) -> tuple[DataFrame, DataFrame]:
    counts = spark.createDataFrame([(s, *c) for s, c in _COUNTS.items()], "scenario string, person int, vehicle int, phone int, account int")
    rows = incidents(spark, d).select(F.col("head").alias("scenario"), "incident_id", F.concat(F.lit("case "), F.col("incident_id").cast("string")).alias("label"), "station", "registered_on")
    return entities.build(rows, counts, _ORDER, store)


@query(_BASE + "SELECT id, kind AS type, scenario, kind || ' ' || (c + 1) || ' ' || (o + 1) AS label FROM e UNION ALL SELECT 'incident:' || incident_id, 'incident', scenario, 'case ' || incident_id FROM p")
def entity_nodes(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark)
    nodes, _ = _graph(spark, d, store)
    out = store.cut(nodes, "nodes")
    store.close(out)
    return out


@query(
    _BASE
    + f"""SELECT 'edge:' || scenario || ':' || c || ':' || kind || ':' || b || ':' || o AS id, 'entity:' || scenario || ':' || c || ':person:' || b AS source, id AS target, rel AS relation, 'generated_scenario' AS support, 0.8::DOUBLE AS weight, scenario FROM (SELECT *, unnest(range(0, person)) AS b FROM e WHERE kind <> 'person')
    UNION ALL SELECT 'edge:' || scenario || ':' || c || ':bridge', 'entity:' || scenario || ':' || (c - 1) || ':person:0', 'entity:' || scenario || ':' || c || ':person:0', 'CO_ACCUSED_WITH', 'generated_scenario', 0.7, scenario FROM cl WHERE c > 0
    UNION ALL SELECT 'edge:' || scenario || ':incident:' || incident_id || ':primary', 'entity:' || scenario || ':' || c || ':person:' || {_WHO}, 'incident:' || incident_id, 'ACCUSED_IN', 'generated_scenario', 1.0, scenario FROM p JOIN k USING (scenario)
    UNION ALL SELECT 'edge:' || scenario || ':similarity:' || before || ':' || incident_id, 'incident:' || before, 'incident:' || incident_id, 'SIMILAR_TO', 'model_similarity', 0.65, scenario FROM (SELECT *, lag(incident_id) OVER (PARTITION BY scenario, c ORDER BY place) AS before FROM p) WHERE before IS NOT NULL"""
)
def entity_edges(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark)
    nodes, edges = _graph(spark, d, store)
    out = store.cut(edges, "edges")
    if not entities.orphans(nodes, out).isEmpty():
        raise ValueError("an edge has an end that is no node")
    store.close(out)
    return out


#: The donors' category of each head; one has none, one no donor.
_DONORS = {"1-URGENT": "purchase", "2-HIGH": "error", "3-MEDIUM": "view", "5-LOW": "refund"}
_KINDS = ("residential", "commercial", "transit", "outdoor")


@query(
    INCIDENTS
    + f""", d AS (SELECT CASE WHEN kind = 'error' AND dayofweek(ts) = 0 THEN 'view' ELSE kind END AS c, [{", ".join(f"'{k}'" for k in _KINDS)}][click_id % 4 + 1] AS p, dayofweek(ts) AS w, hour(ts) AS h FROM clicks WHERE ts IS NOT NULL AND kind IS NOT NULL),
    l AS (SELECT c, p, w, h, grouping_id(c, p, w) AS g, count(*) AS n FROM d GROUP BY GROUPING SETS ((c, p, w, h), (c, w, h), (c, h), (h))), t AS (SELECT c, p, w, g, sum(n) AS n FROM l GROUP BY ALL), big AS (SELECT h, n FROM l WHERE g = 7), tot AS (SELECT sum(n) AS n FROM big),
    taxa AS (SELECT DISTINCT crime_group, head, CASE head {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _DONORS.items())} END AS category FROM inc),
    s AS (SELECT *, CASE premise WHEN 'intersection' THEN 'outdoor' ELSE premise END AS dp FROM taxa, (VALUES {", ".join(f"('{p}')" for p in hours.PREMISES)}) x(premise), range(7) y(weekday)),
    f AS (SELECT s.*, CASE WHEN category IS NULL THEN NULL WHEN a.n IS NOT NULL THEN 0 WHEN b.n IS NOT NULL THEN 2 WHEN e.n IS NOT NULL THEN 3 ELSE 7 END AS g, coalesce(a.n, b.n, e.n, (SELECT n FROM tot)) AS n FROM s
      LEFT JOIN t a ON a.g = 0 AND a.c = category AND a.p = dp AND a.w = weekday LEFT JOIN t b ON b.g = 2 AND b.c = category AND b.w = weekday LEFT JOIN t e ON e.g = 3 AND e.c = category)
    SELECT crime_group, head, category, premise, CAST(weekday AS INT) AS weekday, CASE f.g WHEN 0 THEN '{hours.LEVELS[0]}' WHEN 2 THEN '{hours.LEVELS[1]}' WHEN 3 THEN '{hours.LEVELS[2]}' WHEN 7 THEN '{hours.LEVELS[3]}' ELSE 'not_applicable' END AS level,
      CAST(CASE WHEN f.g IS NULL THEN 0 ELSE f.n END AS BIGINT) AS observations, CAST(z.h AS INT) AS hour, CASE WHEN f.g IS NOT NULL THEN floor((coalesce(l.n, 0) + 48 * coalesce(big.n, 0) / (SELECT n FROM tot)) / (f.n + 48) * 1e9 + 0.5) / 1e9 END AS share
    FROM f, range(24) z(h) LEFT JOIN l ON l.g = f.g AND l.h = z.h AND (f.g > 3 OR l.c = category) AND (f.g > 2 OR l.w = weekday) AND (f.g > 0 OR l.p = dp) LEFT JOIN big ON big.h = z.h"""
)
def time_model_profiles(spark: SparkSession, d: str) -> DataFrame:
    clicks = table(spark, d, "clicks").filter("ts IS NOT NULL AND kind IS NOT NULL")
    weekday = F.dayofweek("ts") - 1
    donors = clicks.select(F.when((F.col("kind") == "error") & (weekday == 0), "view").otherwise(F.col("kind")).alias("category"), F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("click_id") % 4 + 1).cast("int")).alias("premise"), weekday.alias("weekday"), F.hour("ts").alias("hour"))
    known = F.create_map(*[F.lit(x) for kv in _DONORS.items() for x in kv])
    taxa = incidents(spark, d).select("crime_group", "head").distinct().withColumn("category", F.try_element_at(known, F.col("head")))
    store = Store(spark)
    fitted = hours.profiles(taxa, store.cut(hours.counts(donors), "levels"))
    none = F.array(*[F.lit(None).cast("double")] * 24)
    rows = fitted.select("crime_group", "head", "category", "premise", "weekday", "level", "observations", F.posexplode(F.coalesce("shares", none)).alias("hour", "share"))
    out = store.cut(rows.withColumn("share", half_up(F.col("share"), 9)), "profiles")
    store.close(out)
    return out
