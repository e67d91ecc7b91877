"""Checks of tables: claims, reconciliations, drift, orphans, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.catalogue import INCIDENTS, query
from wardline.plans import checks
from wardline.sources.tables import incidents, table


@query("""WITH m(claim, expected, measured) AS (SELECT 'nations', 25, count(*) FROM nation UNION ALL SELECT 'regions', 5, count(*) FROM region UNION ALL SELECT 'statuses', 3, count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'heads', 6, count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'orders', NULL, count(*) FROM orders)
    SELECT claim, expected, measured, CASE WHEN expected IS NULL THEN 'INFO' WHEN expected = measured THEN 'PASS' ELSE 'DRIFT' END AS verdict FROM m""")
def claims(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    one = lambda df, c: df.agg(c.alias("measured"))
    measured = {
        "nations": (25, one(table(spark, d, "nation"), F.count("*"))),
        "regions": (5, one(table(spark, d, "region"), F.count("*"))),
        "statuses": (3, one(orders, F.count_distinct("o_orderstatus"))),
        "heads": (6, one(orders, F.count_distinct("o_orderpriority"))),
        "orders": (None, one(orders, F.count("*"))),
    }
    return checks.claims(measured)


@query(INCIDENTS + """, s AS (SELECT 'rows' AS name, count(*)::DOUBLE AS source FROM orders UNION ALL SELECT 'stage ' || o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'amount', floor(sum(o_totalprice) + 0.5) FROM orders),
    t AS (SELECT 'rows' AS name, count(*)::DOUBLE AS derived FROM inc UNION ALL SELECT 'stage ' || stage, count(*) FROM inc GROUP BY stage UNION ALL SELECT 'amount', floor(sum(amount) + 0.5) FROM inc)
    SELECT name, source, derived, source IS NOT DISTINCT FROM derived AS same FROM s FULL JOIN t USING (name)""")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    orders, inc = table(spark, d, "orders"), incidents(spark, d)
    return checks.reconciled(checks.measures(orders, "o_orderstatus", "o_totalprice"), checks.measures(inc, "stage", "amount"))


@query(INCIDENTS + "SELECT 'stations' AS what, (SELECT count(*) FROM inc) AS whole, CAST((SELECT sum(n) FROM (SELECT count(*) AS n FROM inc GROUP BY station)) AS BIGINT) AS parts, 0 AS difference")
def conservation(spark: SparkSession, d: str) -> DataFrame:
    inc = incidents(spark, d)
    parts = inc.groupBy("station").agg(F.count("*").alias("n"))
    return inc.agg(F.lit("stations").alias("what"), F.count("*").alias("whole")).withColumn("parts", parts.agg(F.sum("n").alias("n")).scalar()).withColumn("difference", (F.col("whole") - F.col("parts")).cast("int"))


_CONTRACT = {"c_custkey": ("bigint", True, None), "c_name": ("string", True, 12), "c_mktsegment": ("string", True, 20), "c_phone": ("string", False, 15)}


@query("""SELECT 'c_name' AS column_name, 'too long' AS fault, count(*) AS n FROM customer WHERE length(c_name) > 12 UNION ALL SELECT 'c_phone', 'missing', 1 UNION ALL SELECT 'c_nationkey', 'extra', 1 UNION ALL SELECT 'c_acctbal', 'extra', 1""")
def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    return checks.drift(table(spark, d, "customer"), _CONTRACT)


@query("SELECT DISTINCT c_nationkey AS orphan FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return checks.orphans(table(spark, d, "customer"), "c_nationkey", table(spark, d, "nation").filter("n_regionkey <> 2"), "n_nationkey")


@query("SELECT l_orderkey, count(*) AS breaks FROM (SELECT l_orderkey, l_quantity, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem) WHERE p < l_quantity GROUP BY 1")
def monotone_ranking(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("l_quantity").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, d, "lineitem").withColumn("p", before).filter("p < l_quantity").groupBy("l_orderkey").agg(F.count("*").alias("breaks"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), r(rule, pattern) AS (VALUES ('address', '[a-z]@[a-z]'), ('secret', '(?i)(password|secret)\\s*[:=]'), ('shouting', '^[A-Z !]{40,}$'), ('never', 'zzzzqqqq'))
    SELECT rule, count(doc_id) AS hits, count(doc_id) = 0 AS dead FROM r LEFT JOIN l ON regexp_matches(line, pattern) GROUP BY rule""")
def lint_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = {"address": "[a-z]@[a-z]", "secret": r"(?i)(password|secret)\s*[:=]", "shouting": "^[A-Z !]{40,}$", "never": "zzzzqqqq"}
    lines = table(spark, d, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return checks.lint(lines, "line", rules)


@query(INCIDENTS + "SELECT incident_id, CASE incident_id % 4 WHEN 0 THEN 'reported' WHEN 1 THEN 'inferred' ELSE 'generated' END AS transformation FROM inc WHERE incident_id % 4 <> 0 AND incident_id % 3 = 0")
def provenance_faults(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("incident_id")
    rows = incidents(spark, d).withColumn("transformation", F.when(k % 4 == 0, "reported").when(k % 4 == 1, "inferred").otherwise("generated")).withColumn("method", F.when(k % 3 != 0, "rule"))
    return checks.unexplained(rows).select("incident_id", "transformation")
