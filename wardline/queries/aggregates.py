"""Aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.catalogue import INCIDENTS, _hmac, query
from wardline.functions import hashing as H
from wardline.functions.scalars import half_up
from wardline.operators import relational as R
from wardline.operators.graph import longest_depths
from wardline.operators.ordered import running
from wardline.sources.scratch import Store
from wardline.sources.tables import incidents, table


@query(INCIDENTS + "SELECT station, any_value(division) AS division, map_from_entries(list((stage, n) ORDER BY stage))::VARCHAR AS stages FROM (SELECT station, division, stage, count(*) AS n FROM inc GROUP BY ALL) GROUP BY station")
def map_pivot(spark: SparkSession, d: str) -> DataFrame:
    cells = incidents(spark, d).groupBy("station", "division", "stage").agg(F.count("*").alias("n"))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stage", "n"))), lambda x: F.concat_ws("=", x["stage"], x["n"].cast("string"))), ", ")
    return cells.groupBy("station").agg(F.any_value("division", True).alias("division"), F.concat(F.lit("{"), said, F.lit("}")).alias("stages"))


@query(INCIDENTS + "SELECT division, station, stage, grouping_id(division, station, stage) AS level, count(*) AS n FROM inc GROUP BY ROLLUP (division, station, stage)")
def rollup_levels(spark: SparkSession, d: str) -> DataFrame:
    return incidents(spark, d).rollup("division", "station", "stage").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@query("SELECT p_type, least(count(DISTINCT p_brand), 20) AS n, count(DISTINCT p_brand) > 20 AS more, count(DISTINCT p_size) > 40 AS many_sizes FROM part GROUP BY p_type")
def capped_distinct(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "part").groupBy("p_type").agg(F.count_distinct("p_brand").alias("k"), F.count_distinct("p_size").alias("s"))
    return by.select("p_type", F.least("k", F.lit(20)).alias("n"), (F.col("k") > 20).alias("more"), (F.col("s") > 40).alias("many_sizes"))


@query("SELECT count(*) AS parts_of_several FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1)")
def keys_with_several(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"))
    return by.agg(F.count_if(F.col("a") != F.col("b")).alias("parts_of_several"))


@query("SELECT e.event_type, t.h AS hour, count(x.h) AS n FROM (SELECT DISTINCT event_type FROM events) e, range(24) t(h) LEFT JOIN (SELECT event_type, hour(ts) AS h FROM events) x ON x.event_type = e.event_type AND x.h = t.h GROUP BY ALL")
def hour_histogram(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "events").groupBy("event_type").agg(*[F.count_if(F.hour("ts") == h).alias(f"h{h}") for h in range(24)])
    return by.select("event_type", F.posexplode(F.array(*[f"h{h}" for h in range(24)])).alias("hour", "n")).withColumn("hour", F.col("hour").cast("long"))


@query("SELECT p_brand, min(p_retailprice) AS low, median(p_retailprice) AS mid, quantile_cont(p_retailprice, 0.95) AS p95, max(p_retailprice) AS high FROM part GROUP BY p_brand")
def percentile_interp(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("p_retailprice")
    by = table(spark, d, "part").groupBy("p_brand").agg(F.percentile(v, F.array(F.lit(0.0), F.lit(0.5), F.lit(0.95), F.lit(1.0))).alias("q"))
    return by.select("p_brand", *[F.element_at("q", k + 1).alias(c) for k, c in enumerate(("low", "mid", "p95", "high"))])


@query(INCIDENTS + "SELECT station, head, n, floor(n * 10000.0 / sum(n) OVER (PARTITION BY station) + 0.5) / 100 AS percent, floor((n - min(n) OVER ()) / nullif(max(n) OVER () - min(n) OVER (), 0)::DOUBLE * 1e9 + 0.5) / 1e9 AS scaled FROM (SELECT station, head, count(*) AS n FROM inc GROUP BY ALL)")
def shares(spark: SparkSession, d: str) -> DataFrame:
    cells = incidents(spark, d).groupBy("station", "head").agg(F.count("*").alias("n"))
    ends = cells.agg(F.min("n").alias("a"), F.max("n").alias("b"))
    cells = cells.withColumn("a", ends.select("a").scalar()).withColumn("b", ends.select("b").scalar())
    percent = F.floor(F.col("n") * 10000.0 / F.sum("n").over(W.partitionBy("station")) + 0.5) / 100
    return cells.select("station", "head", "n", percent.alias("percent"), half_up((F.col("n") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0)), 9).alias("scaled"))


@query(INCIDENTS + "SELECT division, CAST(sum(n) AS BIGINT) AS n, string_agg(station || ':' || n, ',' ORDER BY n DESC, station) AS beats FROM (SELECT division, station, count(*) AS n FROM inc GROUP BY ALL) GROUP BY division")
def nested_counts(spark: SparkSession, d: str) -> DataFrame:
    cells = incidents(spark, d).groupBy("division", "station").agg(F.count("*").alias("n"))
    beats = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "station", "n"))), lambda x: F.concat_ws(":", x["station"], x["n"].cast("string"))), ",")
    return cells.groupBy("division").agg(F.sum("n").alias("n"), beats.alias("beats"))


@query(INCIDENTS + """, s AS (SELECT incident_id, unnest(['station|' || station, 'division|' || division, 'head|' || head, 'group|' || crime_group, 'stage|' || stage]) AS stratum FROM inc)
    SELECT stratum, incident_id FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY incident_id) AS r FROM s) WHERE r <= 2""")
def first_two_per_stratum(spark: SparkSession, d: str) -> DataFrame:
    strata = F.array(*[F.concat(F.lit(f"{k}|"), c) for k, c in (("station", "station"), ("division", "division"), ("head", "head"), ("group", "crime_group"), ("stage", "stage"))])
    return R.top_per_group(incidents(spark, d).select(F.explode(strata).alias("stratum"), "incident_id"), ["stratum"], [F.col("incident_id")], 2)


_SAID = "o_orderkey || chr(31) || coalesce(o_custkey::VARCHAR, '') || chr(31) || coalesce(o_orderstatus, '') || chr(31) || coalesce(strftime(o_orderdate, '%Y-%m-%d'), '')"
_CHUNK = 100


@query(f"""WITH a AS (SELECT o_orderkey // {_CHUNK} AS k, sha256(string_agg({_SAID}, chr(10) ORDER BY o_orderkey)) AS h, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT k // {_CHUNK} AS k, sha256(string_agg(h, chr(10) ORDER BY k)) AS h, sum(n) AS n FROM a GROUP BY 1),
    c AS (SELECT k // {_CHUNK} AS k, sha256(string_agg(h, chr(10) ORDER BY k)) AS h, sum(n) AS n FROM b GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY k)) AS digest FROM c""")
def logical_hash(spark: SparkSession, d: str) -> DataFrame:
    """A digest of all rows in their order, as a tree: digests of runs of a hundred keys, and of runs of those, so that no task has more."""
    row = F.concat_ws("\x1f", F.col("o_orderkey").cast("string"), F.coalesce(F.col("o_custkey").cast("string"), F.lit("")), F.coalesce("o_orderstatus", F.lit("")), F.coalesce(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("")))
    return R.tree_digest(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), row.alias("said")), _CHUNK, 3)


@query("""SELECT 'c_name' AS name, 'string' AS type, max(length(c_name)) AS longest, count(*) - count(c_name) AS nulls FROM customer UNION ALL SELECT 'c_mktsegment', 'string', max(length(c_mktsegment)), count(*) - count(nullif(c_mktsegment, '')) FROM customer
    UNION ALL SELECT 'c_custkey', 'bigint', max(length(c_custkey::VARCHAR)), count(*) - count(c_custkey) FROM customer UNION ALL SELECT 'c_nationkey', 'int', max(length(c_nationkey::VARCHAR)), count(*) - count(c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', 'double', NULL, count(*) - count(c_acctbal) FROM customer""")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    one = [F.struct(F.lit(c).alias("name"), F.lit(t).alias("type"), (F.max(F.length(F.col(c).cast("string"))).cast("long") if t != "double" else F.lit(None).cast("long")).alias("longest"), (F.count("*") - F.count(c)).alias("nulls")) for c, t in rows.dtypes]
    return rows.agg(F.array(*one).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, max(l_quantity) AS weight, arg_max(l_orderkey, (l_quantity, -l_orderkey, -l_linenumber)) AS strongest FROM lineitem GROUP BY 1, 2")
def best_pair(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("a", F.least("l_suppkey", "l_partkey")).withColumn("b", F.greatest("l_suppkey", "l_partkey"))
    order = F.struct("l_quantity", -F.col("l_orderkey"), -F.col("l_linenumber"))
    return rows.groupBy("a", "b").agg(F.max("l_quantity").alias("weight"), F.max_by("l_orderkey", order).alias("strongest"))


@query("""WITH c AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), q AS (SELECT quantile_cont(n, 0.1) AS a, quantile_cont(n, 0.9) AS b FROM c), w AS (SELECT k, n, least(greatest(n, a), b) AS v FROM c, q)
    SELECT k, n, v, floor(v / sum(v) OVER () * 1e9 + 0.5) / 1e9 AS share FROM w""")
def winsorised_quota(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.percentile("n", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    w = counts.withColumn("q", ends.scalar()).withColumn("v", F.least(F.greatest(F.col("n").cast("double"), F.element_at("q", 1)), F.element_at("q", 2)))
    return w.withColumn("all", w.agg(F.sum("v").alias("s")).scalar()).select("k", "n", "v", half_up(F.col("v") / F.col("all"), 9).alias("share"))


_MAP = "SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = '{}' GROUP BY 1"


@query(f"WITH a AS ({_MAP.format('O')}), b AS ({_MAP.format('F')}) SELECT coalesce(a.k, b.k) AS k, a.n AS n_open, b.n AS n_closed, a.n IS DISTINCT FROM b.n AS differs FROM a FULL JOIN b ON a.k = b.k")
def count_maps_differ(spark: SparkSession, d: str) -> DataFrame:
    """Two maps of counts side by side, with keys that only one has."""
    by = lambda s, n: table(spark, d, "orders").filter(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias(n))
    both = by("O", "n_open").join(by("F", "n_closed"), "k", "full")
    return both.withColumn("differs", ~F.col("n_open").eqNullSafe(F.col("n_closed")))


#: The way of a case to each stage that it may end in.
_PATHS = {
    "pending_trial": "registered>under_investigation>traced>chargesheeted>pending_trial",
    "undetected": "registered>under_investigation>undetected",
    "convicted": "registered>under_investigation>traced>chargesheeted>pending_trial>convicted",
    "traced": "registered>under_investigation>traced",
    "under_investigation": "registered>under_investigation",
    "false_case": "registered>under_investigation>false_case",
    "compounded": "registered>under_investigation>traced>compounded",
    "discharged_acquitted": "registered>under_investigation>traced>chargesheeted>pending_trial>discharged_acquitted",
    "bound_over": "registered>under_investigation>traced>bound_over",
    "other_disposal": "registered>under_investigation>other_disposal",
    "un_traced": "registered>under_investigation>traced>un_traced",
    "abated": "registered>under_investigation>traced>chargesheeted>pending_trial>abated",
    "transferred": "registered>transferred",
}
_PATH_SQL = f"WITH p(stage, path, n) AS (SELECT stage, path, count(*) FROM (SELECT [{', '.join(f"'{k}'" for k in _PATHS)}][o_orderkey % {len(_PATHS)} + 1] AS stage FROM orders) JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _PATHS.items()) + ") t(k, path) ON k = stage GROUP BY ALL)"


def _flows(spark: SparkSession, d: str) -> DataFrame:
    stage = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("o_orderkey") % len(_PATHS)).cast("int") + 1)
    counts = table(spark, d, "orders").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))
    path = F.split(F.element_at(F.create_map(*[F.lit(x) for kv in _PATHS.items() for x in kv]), F.col("stage")), ">")
    edges = counts.select("n", F.explode(F.arrays_zip(F.slice(path, 1, F.size(path) - 1).alias("a"), F.slice(path, 2, F.size(path) - 1).alias("b"))).alias("e"))
    return edges.groupBy(F.col("e.a").alias("source"), F.col("e.b").alias("target")).agg(F.sum("n").alias("n"))


@query(_PATH_SQL + ", x AS (SELECT n, string_split(path, '>') AS s FROM p) SELECT source, target, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, unnest(s[1:len(s) - 1]) AS source, unnest(s[2:]) AS target FROM x) GROUP BY ALL")
def path_flow(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d)


@query(_PATH_SQL + """, x AS (SELECT n, string_split(path, '>') AS s FROM p), e AS (SELECT source, target, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, unnest(s[1:len(s) - 1]) AS source, unnest(s[2:]) AS target FROM x) GROUP BY ALL),
    v AS (SELECT DISTINCT u AS node FROM (SELECT source AS u FROM e UNION ALL SELECT target FROM e)),
    depth AS (SELECT node, coalesce(max(len(s[1:list_position(s, node)]) - 1), 0) AS depth FROM v, x WHERE list_contains(s, node) GROUP BY node)
    SELECT node, depth, greatest(coalesce((SELECT sum(n) FROM e WHERE target = node), 0), coalesce((SELECT sum(n) FROM e WHERE source = node), 0))::BIGINT AS flow,
      coalesce(sum(greatest(coalesce((SELECT sum(n) FROM e WHERE target = node), 0), coalesce((SELECT sum(n) FROM e WHERE source = node), 0))::BIGINT) OVER (PARTITION BY depth ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS layout_offset FROM depth""")
def flow_layout(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark)
    edges = store.cut(_flows(spark, d), "flows")
    depth = longest_depths(edges, store)
    inflow = edges.groupBy(F.col("target").alias("node")).agg(F.sum("n").alias("i"))
    outflow = edges.groupBy(F.col("source").alias("node")).agg(F.sum("n").alias("o"))
    rows = depth.join(inflow, "node", "left").join(outflow, "node", "left").withColumn("flow", F.greatest(F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))))
    before = F.coalesce(F.sum("flow").over(W.partitionBy("depth").orderBy("node").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = store.cut(rows.select("node", "depth", "flow", before.alias("layout_offset")), "layout")
    store.close(out)
    return out


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS i, o_orderpriority AS g FROM orders)
    SELECT g, i // 20 AS bucket, id, lag(id) OVER (PARTITION BY g, i // 20 ORDER BY i) AS before FROM o""")
def bucket_lag(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each priority in order, in buckets of twenty, each with the one before it in its bucket; places are taken by ranges."""
    store = Store(spark)
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), "o_orderdate", F.col("o_orderkey").alias("id"))
    ranked = store.cut(running(rows, [F.col("g"), F.col("o_orderdate"), F.col("id")], {}, store, "i"), "ranked")
    first = ranked.groupBy("g").agg(F.min("i").alias("first"))
    placed = ranked.join(first, "g").withColumn("i", F.col("i") - F.col("first")).withColumn("bucket", F.expr("i div 20"))
    out = store.cut(placed.select("g", "bucket", "id", F.lag("id").over(W.partitionBy("g", "bucket").orderBy("i")).alias("before")), "buckets")
    store.close(out)
    return out


@query("""WITH h AS (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT *, coalesce(lag(n) OVER w, last_value(n) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev FROM h WINDOW w AS (PARTITION BY event_type ORDER BY h))
    SELECT event_type, arg_max(h, (n, -h)) AS peak_hour, max(n) AS peak, arg_max(h, (prev - n, -h)) AS fall_hour, max(prev - n) AS fall FROM l GROUP BY event_type""")
def circular_lag(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "events").groupBy("event_type", F.hour("ts").cast("long").alias("h")).agg(F.count("*").alias("n"))
    by = W.partitionBy("event_type").orderBy("h")
    last = F.last("n").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = h.withColumn("fall", F.coalesce(F.lag("n").over(by), last) - F.col("n"))
    first = lambda v: F.max_by("h", F.struct(v, -F.col("h")))
    return rows.groupBy("event_type").agg(first(F.col("n")).alias("peak_hour"), F.max("n").alias("peak"), first(F.col("fall")).alias("fall_hour"), F.max("fall").alias("fall"))


@query("SELECT v AS threshold, CAST(floor(0.9 * n) AS BIGINT) AS place FROM (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER () AS n FROM customer) WHERE r = floor(0.9 * n) + 1")
def p90_threshold(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark)
    ranked = running(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")], {}, store)
    n = table(spark, d, "customer").agg(F.count("*").alias("n"))
    out = store.cut(ranked.withColumn("place", F.floor(F.lit(0.9) * n.scalar()).cast("long")).filter("rank = place + 1").select(F.col("c_acctbal").alias("threshold"), "place"), "p90")
    store.close(out)
    return out


@query(f"""WITH p AS (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY h) / sum(n) OVER (PARTITION BY event_type)::DOUBLE AS upto, n / sum(n) OVER (PARTITION BY event_type)::DOUBLE AS share FROM p),
    o AS (SELECT o_orderkey AS id, CASE o_orderkey % 2 WHEN 0 THEN 'click' ELSE 'view' END AS event_type, CAST(CAST('0x' || substr({_hmac("'1|hour|' || o_orderkey || '|'")}, 1, 16) AS UBIGINT) >> 11 AS DOUBLE) / 9007199254740992.0 AS u FROM orders)
    SELECT id, min(h) AS hour, floor(arg_min(share, h) * 1e9 + 0.5) / 1e9 AS confidence FROM o JOIN c USING (event_type) WHERE u < upto GROUP BY id""")
def time_model_apply(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("event_type").agg(*[F.count_if(F.hour("ts") == h).alias(f"h{h}") for h in range(24)])
    total = sum((F.col(f"h{h}") for h in range(24)), F.lit(0))
    profile = counts.select("event_type", F.array(*[(F.col(f"h{h}") / total) for h in range(24)]).alias("p"), F.array(*[(sum((F.col(f"h{j}") for j in range(h + 1)), F.lit(0)) / total) for h in range(24)]).alias("upto"))
    kind = F.when(F.col("o_orderkey") % 2 == 0, "click").otherwise("view")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("event_type"), H.unit_draw("hour", F.col("o_orderkey").cast("string")).alias("u"))
    # The first hour whose cumulative share passes the draw.
    hour = F.element_at(F.filter(F.transform("upto", lambda x, i: F.when(F.col("u") < x, i)), lambda i: i.isNotNull()), 1)
    return rows.join(profile, "event_type").select("id", hour.cast("long").alias("hour"), half_up(F.element_at("p", hour + 1), 9).alias("confidence"))


@query(f"SELECT o_orderkey, CAST(CAST('0x' || substr({_hmac("'1|sample|' || o_orderkey || '|replay'")}, 1, 16) AS UBIGINT) % 360 AS BIGINT) AS minute FROM orders ORDER BY CAST('0x' || substr({_hmac("'1|order|' || o_orderkey || '|replay'")}, 1, 16) AS UBIGINT) % 1000000, o_orderkey LIMIT 120")
def random_order_sample(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, d, "orders").select("o_orderkey", H.stable_index("sample", key, "replay", 360).alias("minute"), H.stable_index("order", key, "replay", 1_000_000).alias("place"))
    return rows.orderBy("place", "o_orderkey").limit(120).drop("place")


_VICTIMS = {"male": "incident_id % 2", "female": "incident_id % 3 // 2", "boy": "incident_id % 5 // 4", "girl": "incident_id % 7 // 6"}


@query(
    INCIDENTS
    + f""", a AS (SELECT *, crime_group = 'MACHINERY' AS cyber, strftime(registered_on, '%Y-%m') AS month, year(registered_on)::VARCHAR AS y, ['online', 'written', 'oral'][incident_id % 3 + 1] AS mode, registered_on <= DATE '2000-12-31' AS whole FROM inc), c AS (SELECT * FROM a WHERE cyber)
    SELECT 'summary' AS kind, 'cyber_records' AS k1, NULL::VARCHAR AS k2, count(*) FILTER (WHERE cyber) AS n, count(*) AS m, floor(count(*) FILTER (WHERE cyber) * 10000.0 / count(*) + 0.5) / 100 AS share, NULL::BOOLEAN AS partial_window FROM a
    UNION ALL SELECT 'month', month, NULL, count(*) FILTER (WHERE cyber), count(*), NULL, NOT bool_and(whole) FROM a GROUP BY month
    UNION ALL SELECT * FROM (SELECT 'section', head || ' ' || station, NULL, count(*) AS n, NULL, NULL, NULL FROM c GROUP BY head, station ORDER BY n DESC, head || ' ' || station LIMIT 18)
    UNION ALL SELECT 'mode', mode, NULL, count(*), NULL, NULL, NULL FROM c GROUP BY mode
    UNION ALL SELECT 'mode_year', y, mode, count(*), NULL, NULL, NULL FROM c GROUP BY y, mode
    UNION ALL SELECT 'outcome', stage, NULL, count(*), NULL, NULL, NULL FROM c GROUP BY stage
    {" ".join(f"UNION ALL SELECT 'victims', '{k}', NULL, CAST(sum({v}) AS BIGINT), NULL, NULL, NULL FROM c" for k, v in _VICTIMS.items())}"""
)
def cyber_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """All that the cyber wing shows, from one aggregate of the finest cells."""
    store = Store(spark)
    inc, k = incidents(spark, d), F.col("incident_id")
    day = F.col("registered_on")
    keys = {"cyber": F.col("crime_group") == "MACHINERY", "month": F.date_format(day, "yyyy-MM"), "y": F.year(day).cast("string"), "mode": F.element_at(F.array(*map(F.lit, ("online", "written", "oral"))), (k % 3 + 1).cast("int")), "section": F.concat_ws(" ", "head", "station"), "stage": F.col("stage"), "whole": day <= F.lit("2000-12-31").cast("date")}
    sums = [F.sum(F.expr(v.replace("//", "div"))).cast("long").alias(name) for name, v in _VICTIMS.items()]
    fine = store.cut(inc.groupBy(*[c.alias(name) for name, c in keys.items()]).agg(F.count("*").alias("n"), *sums), "cells")
    cyber = fine.filter("cyber")
    none = {"k2": F.lit(None).cast("string"), "m": F.lit(None).cast("long"), "share": F.lit(None).cast("double"), "partial_window": F.lit(None).cast("boolean")}

    def said(df: DataFrame, kind: str, k1: Column, **more: Column) -> DataFrame:
        own = none | more
        return df.select(F.lit(kind).alias("kind"), k1.alias("k1"), own["k2"].alias("k2"), "n", *[own[c].alias(c) for c in ("m", "share", "partial_window")])

    by = lambda *c: cyber.groupBy(*c).agg(F.sum("n").alias("n"))
    of_cyber = F.coalesce(F.sum(F.when(F.col("cyber"), F.col("n"))), F.lit(0)).alias("n")
    whole = fine.agg(of_cyber, F.sum("n").alias("all"))
    month = fine.groupBy("month").agg(of_cyber, F.sum("n").alias("all"), (~F.bool_and("whole")).alias("partial"))
    rows = said(whole, "summary", F.lit("cyber_records"), m=F.col("all"), share=F.floor(F.col("n") * 10000.0 / F.col("all") + 0.5) / 100)
    rows = rows.unionAll(said(month, "month", F.col("month"), m=F.col("all"), partial_window=F.col("partial")))
    rows = rows.unionAll(said(by("section").orderBy(F.col("n").desc(), "section").limit(18), "section", F.col("section")))
    rows = rows.unionAll(said(by("mode"), "mode", F.col("mode"))).unionAll(said(by("y", "mode"), "mode_year", F.col("y"), k2=F.col("mode"))).unionAll(said(by("stage"), "outcome", F.col("stage")))
    for name in _VICTIMS:
        rows = rows.unionAll(said(cyber.agg(F.sum(name).alias("n")), "victims", F.lit(name)))
    out = store.cut(rows, "wing")
    store.close(out)
    return out


@query("SELECT l_suppkey AS origin, l_partkey AS dest, row_number() OVER (ORDER BY l_suppkey, l_partkey) AS place FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def pair_order(spark: SparkSession, d: str) -> DataFrame:
    """Pairs in the order of their numbers, not of their texts; places are taken by ranges."""
    store = Store(spark)
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("origin"), F.col("l_partkey").alias("dest")).distinct()
    out = store.cut(running(pairs, [F.col("origin"), F.col("dest")], {}, store, "place"), "ordered")
    store.close(out)
    return out
