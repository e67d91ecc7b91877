"""Filters, the query language, joins, order and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.catalogue import INCIDENTS, query
from wardline.functions import text as T
from wardline.functions.scalars import half_up
from wardline.operators import relational as R
from wardline.plans.language import Filter, IncidentRequest, TableQuery
from wardline.sources.tables import incidents, table


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders
    WHERE o_totalprice >= 50000 AND o_orderstatus IN ('O', 'F') AND o_orderpriority <> '5-LOW' AND o_custkey IS NOT NULL GROUP BY ALL ORDER BY n DESC NULLS LAST, o_orderpriority LIMIT 6 OFFSET 1""")
def table_query_paged(spark: SparkSession, d: str) -> DataFrame:
    filters = [Filter("o_totalprice", "gte", 50000), Filter("o_orderstatus", "in", ["O", "F"]), Filter("o_orderpriority", "ne", "5-LOW"), Filter("o_custkey", "ne", None)]
    aggregates = [("count", "*", "n"), ("sum", "o_totalprice", "total"), ("avg", "o_totalprice", "mean"), ("min", "o_orderkey", "first_key"), ("max", "o_orderkey", "last_key")]
    keys = ["o_orderpriority", "o_orderstatus"]
    return TableQuery("orders", keys, aggregates, filters, keys, [("n", "desc"), ("o_orderpriority", "asc")], 6, 1).run({"orders": table(spark, d, "orders")})


@query(INCIDENTS + "SELECT * FROM inc WHERE station = 'NATION_7' AND registered_on >= DATE '1998-01-01' AND registered_on <= DATE '1999-12-31' ORDER BY registered_on DESC, incident_id LIMIT 200 OFFSET 5")
def incident_request(spark: SparkSession, d: str) -> DataFrame:
    return IncidentRequest(station="NATION_7", start="1998-01-01", end="1999-12-31", limit=200, offset=5).run(incidents(spark, d))


@query(INCIDENTS + "SELECT * FROM inc WHERE division ILIKE 'a%ca' OR station ILIKE 'a%ca' OR head ILIKE 'a%ca' OR crime_group ILIKE 'a%ca' ORDER BY registered_on DESC, incident_id LIMIT 500")
def incident_search(spark: SparkSession, d: str) -> DataFrame:
    return IncidentRequest(search="a*ca", limit=5000).run(incidents(spark, d))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%' AND contains(lower(p_type), 'e')")
def prefix_and_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.startswith("p_name", F.lit("red")) & F.contains(F.lower("p_type"), F.lit("e"))).select("p_partkey", "p_name")


@query("SELECT n_name AS station, alert_id, score FROM nation LEFT JOIN (SELECT o_orderkey AS alert_id, o_orderpriority AS place, o_totalprice AS score FROM orders WHERE false) ON place = n_name")
def typed_empty(spark: SparkSession, d: str) -> DataFrame:
    """A scan that is never true keeps its types: every station, with the alerts that it doesn't have."""
    none = table(spark, d, "orders").filter(F.lit(False)).select(F.col("o_orderkey").alias("alert_id"), F.col("o_orderpriority").alias("place"), F.col("o_totalprice").alias("score"))
    return table(spark, d, "nation").join(none, F.col("place") == F.col("n_name"), "left").select(F.col("n_name").alias("station"), "alert_id", "score")


_NULL_SAFE = """
    WITH a AS (SELECT nullif(c_mktsegment, 'BUILDING') AS seg, c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL),
    b AS (SELECT nullif(c_mktsegment, 'BUILDING') AS seg, c_nationkey AS k, count(*) AS m FROM customer WHERE c_acctbal > 0 GROUP BY ALL)
"""


@query(_NULL_SAFE + "SELECT a.seg, a.k, n, coalesce(m, 0) AS m, n IS DISTINCT FROM m AS differs FROM a LEFT JOIN b ON a.seg IS NOT DISTINCT FROM b.seg AND a.k = b.k")
def join_null_safe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING"))).withColumn("k", F.col("c_nationkey"))
    a = rows.groupBy("seg", "k").agg(F.count("*").alias("n"))
    b = rows.filter("c_acctbal > 0").groupBy(F.col("seg").alias("seg2"), F.col("k").alias("k2")).agg(F.count("*").alias("m"))
    both = a.join(b, F.col("seg").eqNullSafe(F.col("seg2")) & (F.col("k") == F.col("k2")), "left")
    return both.select("seg", "k", "n", F.coalesce("m", F.lit(0)).alias("m"), (~F.col("n").eqNullSafe(F.col("m"))).alias("differs"))


@query("""WITH t AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS day, o_totalprice AS v FROM orders WHERE o_orderkey % 50 = 0)
    SELECT t.id, count(*) AS n_before, max(o.o_orderdate)::DATE AS last_before, sum(o.o_totalprice) AS total_before FROM t JOIN orders o ON o.o_custkey = t.k AND o.o_orderdate < t.day AND o.o_orderkey <> t.id GROUP BY t.id""")
def join_theta_prior(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    t = orders.filter("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("day"))
    both = orders.join(t, (F.col("o_custkey") == F.col("k")) & (F.col("o_orderdate") < F.col("day")) & (F.col("o_orderkey") != F.col("id")))
    return both.groupBy("id").agg(F.count("*").alias("n_before"), F.to_date(F.max("o_orderdate")).alias("last_before"), F.sum("o_totalprice").alias("total_before"))


_CHAIN = "SELECT p_partkey, p_brand || '|' || p_type AS k1, p_type AS k2, p_retailprice AS v FROM part"


@query(f"""WITH p AS ({_CHAIN}), a AS (SELECT k1, avg(v) AS m FROM p GROUP BY k1 HAVING count(*) >= 12), b AS (SELECT k2, avg(v) AS m FROM p GROUP BY k2 HAVING count(*) >= 30), c AS (SELECT avg(v) AS m FROM p)
    SELECT p_partkey, CASE WHEN a.m IS NOT NULL THEN 'brand' WHEN b.m IS NOT NULL THEN 'type' ELSE 'all' END AS level, floor(coalesce(a.m, b.m, (SELECT m FROM c)) * 1e4 + 0.5) / 1e4 AS profile FROM p LEFT JOIN a USING (k1) LEFT JOIN b USING (k2)""")
def join_fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("k1"), F.col("p_type").alias("k2"), F.col("p_retailprice").alias("v"))
    level = lambda k, n, m: p.groupBy(k).agg(F.avg("v").alias(m), F.count("*").alias("n")).filter(F.col("n") >= n).drop("n")
    rows = p.join(level("k1", 12, "m1"), "k1", "left").join(level("k2", 30, "m2"), "k2", "left").withColumn("m3", p.agg(F.avg("v").alias("m")).scalar())
    value = F.floor(F.coalesce("m1", "m2", "m3") * 1e4 + 0.5) / 1e4
    return rows.select("p_partkey", F.when(F.col("m1").isNotNull(), "brand").when(F.col("m2").isNotNull(), "type").otherwise("all").alias("level"), value.alias("profile"))


_TOKENS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '' AND t NOT IN ('ps', 'police', 'station')))"


_PLAIN = "regexp_replace(regexp_replace(replace(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '&', 'and'), '\\b(?:police|station|ps|traffic)\\b', '', 'g'), '[^a-z0-9]', '', 'g')"


@query(f"""WITH a AS (SELECT DISTINCT name AS x, {_TOKENS.format("name")} AS s FROM clients WHERE name IS NOT NULL), b AS (SELECT DISTINCT name AS y, {_TOKENS.format("name")} AS t FROM vendors WHERE name IS NOT NULL),
    r AS (SELECT x, y, CASE WHEN len(s) = 0 OR len(t) = 0 THEN 0 ELSE 2 * coalesce(list_sum(list_transform(s, lambda p: CASE WHEN list_contains(t, p) THEN 1.0::DOUBLE
      WHEN len(list_filter(t, lambda o: length(p) >= 5 AND length(o) >= 5 AND starts_with(CASE WHEN length(p) < length(o) THEN o ELSE p END, substr(CASE WHEN length(p) < length(o) THEN p ELSE o END, 1, 6)))) > 0 THEN 0.9 ELSE 0 END)), 0) / (len(s) + len(t)) END AS ratio FROM a, b),
    k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY ratio DESC, y) AS r FROM r WHERE ratio > 0.35), n AS (SELECT *, {_PLAIN.format("x")} AS p, {_PLAIN.format("y")} AS q FROM k WHERE r <= 3)
    SELECT x, y, floor(ratio * 1e9 + 0.5) / 1e9 AS ratio, floor(CASE WHEN p = '' OR q = '' THEN 0 ELSE 1 - levenshtein(p, q) / greatest(length(p), length(q)) END * 1e9 + 0.5) / 1e9 AS edit FROM n""")
def join_fuzzy_token_set(spark: SparkSession, d: str) -> DataFrame:
    """The three vendors whose names are most like a client's.

    A vendor that shares one of the client's words ranks behind three that come first among those with the same key and as
    many words: they share no less. So of each key and number of words three are looked at, and besides all that share two keys.
    """
    names = lambda t, c, words: table(spark, d, t).filter("name IS NOT NULL").select(F.col("name").alias(c)).distinct().withColumn(words, T.name_words(F.col(c)))
    clients, vendors = names("clients", "x", "s"), names("vendors", "y", "t")
    keyed = lambda df, words, asked, pairs: df.select("*", F.explode((T.key_pairs if pairs else lambda k: F.array_distinct(F.flatten(k)))(T.name_keys(F.col(words), asked))).alias("key"))
    ways = [R.top_per_group(keyed(vendors, "t", False, False).withColumn("n", F.size("t")), ["key", "n"], [F.col("y")], 3).drop("n"), keyed(vendors, "t", False, True)]
    met = [keyed(clients, "s", True, pairs).join(given, "key").select("x", "y", T.words_ratio(F.col("s"), F.col("t")).alias("ratio")).filter("ratio > 0.35") for pairs, given in enumerate(ways)]
    # Pairs that meet by several keys come with the same place.
    place = F.dense_rank().over(W.partitionBy("x").orderBy(F.col("ratio").desc(), F.col("y")))
    best = met[0].unionAll(met[1]).withColumn("place", place).filter("place <= 3").dropDuplicates(["x", "y"])
    return best.select("x", "y", half_up(F.col("ratio"), 9).alias("ratio"), half_up(T.edit_ratio(F.col("x"), F.col("y")), 9).alias("edit"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem) SELECT a, b, s_name, p_name, s_suppkey IS NULL OR p_partkey IS NULL AS orphan FROM e LEFT JOIN supplier ON a = s_suppkey AND s_acctbal > 0 LEFT JOIN part ON b = p_partkey""")
def edge_endpoints(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    left = table(spark, d, "supplier").filter("s_acctbal > 0")
    both = edges.join(left, F.col("a") == F.col("s_suppkey"), "left").join(table(spark, d, "part"), F.col("b") == F.col("p_partkey"), "left")
    return both.select("a", "b", "s_name", "p_name", (F.col("s_suppkey").isNull() | F.col("p_partkey").isNull()).alias("orphan"))


@query("SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS seg FROM customer ORDER BY CASE WHEN c_custkey = 7 THEN 0 ELSE 1 END, seg DESC NULLS LAST, c_custkey LIMIT 40")
def order_nulls_front(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("seg"))
    return rows.orderBy((F.col("c_custkey") == 7).desc(), F.col("seg").desc_nulls_last(), "c_custkey").limit(40)


@query("""SELECT 'supplier' AS kind, s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL UNION ALL SELECT 'customer', c_nationkey, count(*) FROM customer GROUP BY ALL UNION ALL SELECT 'nation', n_nationkey, 1 FROM nation""")
def union_all_tagged(spark: SparkSession, d: str) -> DataFrame:
    by = lambda kind, t, k: table(spark, d, t).groupBy(F.lit(kind).alias("kind"), F.col(k).alias("k")).agg(F.count("*").alias("n"))
    return by("supplier", "supplier", "s_nationkey").unionByName(by("customer", "customer", "c_nationkey")).unionByName(by("nation", "nation", "n_nationkey"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A')
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'second' WHEN b.k IS NULL THEN 'first' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def set_sides(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter("l_returnflag IN ('R', 'A')")
    by = rows.groupBy(F.col("l_partkey").alias("k")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "A").alias("a"))
    return by.select("k", F.when(~F.col("r"), "second").when(~F.col("a"), "first").otherwise("both").alias("side"))


@query("SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("m"))
    return rows.select("l_suppkey", "l_returnflag", "m.l_orderkey", "m.l_linenumber")


@query("""WITH s AS (SELECT l_suppkey AS unit, list_distinct(list(l_partkey)) AS cells FROM lineitem GROUP BY 1) SELECT unit % 5 AS team, count(DISTINCT c) AS covered FROM (SELECT unit, unnest(cells) AS c FROM s) GROUP BY 1""")
def coverage_union(spark: SparkSession, d: str) -> DataFrame:
    """What a team's units cover together: bitsets of as many words as cells need, each word an aggregate with map-side combine."""
    cell = F.col("l_partkey")
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("team"), F.expr("l_partkey div 64").alias("word"), F.expr("shiftleft(1L, CAST(l_partkey % 64 AS INT))").alias("bit")).filter(cell.isNotNull())
    words = rows.groupBy("team", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("team").agg(F.sum(F.bit_count("bits")).cast("long").alias("covered"))


@query("SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def last_k(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", rank.cast("long").alias("r")).filter("r <= 3")
