"""The registered queries of the reference's operators, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.functions import hashing as H
from wardline.functions import scalars as S
from wardline.functions import text as T
from wardline.operators import relational as R
from wardline.operators import text_search
from wardline.operators.similar import cosines, matrix, nearest
from wardline.plans.baselines import baselines, weekly_counts
from wardline.sources.scratch import tidy
from wardline.sources.tables import incidents, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The incident fact in SQL.
INCIDENTS = """
    WITH inc AS (
      SELECT o_orderkey AS incident_id, n_name AS station, r_name AS division, o_orderpriority AS head,
        c_mktsegment AS crime_group, o_orderstatus AS stage, CAST(o_orderdate AS DATE) AS registered_on, o_totalprice AS amount
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    )
"""
#: The last day of the complete window, and the day open cases are aged at.
WINDOW_END = "2000-12-31"


#: Stages that a case of each status went through.
_WAYS = {"O": ("registered", "under_investigation"), "P": ("registered", "under_investigation", "traced", "chargesheeted", "pending_trial"), "F": ("registered", "under_investigation", "undetected")}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query with its SQL; with none where SQL can't say it, and a test holds it to plain Python."""

    def keep(f: Query) -> Query:
        f = tidy(f)
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate::DATE AS shipped FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def filter_in_between(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter(F.col("l_returnflag").isin("R", "A") & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", F.to_date("l_shipdate").alias("shipped"))


@query("SELECT doc_id, lang, source FROM documents WHERE text ILIKE '%the%of%' OR source ILIKE '%the%of%' ORDER BY doc_id LIMIT 500")
def text_search_wildcard(spark: SparkSession, d: str) -> DataFrame:
    rows = text_search.search(table(spark, d, "documents"), "*the*of*", ["text", "source"], ["doc_id"], 500)
    return rows.select("doc_id", "lang", "source")


@query(INCIDENTS + "SELECT DISTINCT crime_group, head FROM inc")
def distinct_taxa(spark: SparkSession, d: str) -> DataFrame:
    return incidents(spark, d).select("crime_group", "head").distinct()


@query(INCIDENTS + "SELECT * FROM inc WHERE division = 'ASIA' AND registered_on >= DATE '1999-01-01' ORDER BY registered_on DESC, incident_id LIMIT 100 OFFSET 100")
def incident_page(spark: SparkSession, d: str) -> DataFrame:
    rows = incidents(spark, d).filter("division = 'ASIA' AND registered_on >= DATE '1999-01-01'")
    return rows.orderBy(F.col("registered_on").desc(), "incident_id").offset(100).limit(100)


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(sum(o_totalprice), 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left_coalesce(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    joined = table(spark, d, "customer").join(by, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"), F.coalesce("t", F.lit(0.0)).alias("total"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-05-01')")
def join_anti_orphans(spark: SparkSession, d: str) -> DataFrame:
    late = table(spark, d, "orders").filter("o_orderdate >= DATE '2001-05-01'")
    return table(spark, d, "customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) > 800)")
def join_semi_eligible(spark: SparkSession, d: str) -> DataFrame:
    eligible = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")).filter("q > 800")
    return table(spark, d, "part").join(eligible, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query(
    INCIDENTS
    + """, m AS (SELECT head, station, date_trunc('month', registered_on) AS month, count(*) AS n FROM inc GROUP BY ALL)
    SELECT i.head, count(*) AS n_incidents, count(DISTINCT station) AS n_stations, count(DISTINCT division) AS n_divisions,
      (SELECT max(n) FROM m WHERE m.head = i.head) AS peak_month
    FROM inc i GROUP BY i.head"""
)
def spine_ranking(spark: SparkSession, d: str) -> DataFrame:
    # One aggregate of the finest cells; the rest comes from those.
    month = incidents(spark, d).groupBy("head", "station", "division", F.date_trunc("month", "registered_on").alias("month")).agg(F.count("*").alias("n"))
    return month.groupBy("head").agg(F.sum("n").alias("n_incidents"), F.count_distinct("station").alias("n_stations"), F.count_distinct("division").alias("n_divisions"), F.max("n").alias("peak_month"))


@query(
    INCIDENTS
    + """SELECT station, count(*) AS n, count(*) FILTER (WHERE stage = 'O') AS n_open, floor(sum(amount) FILTER (WHERE stage = 'F') + 0.5) AS closed_amount,
      bool_and(amount > 0) AS all_positive, count(DISTINCT head) AS n_heads, min(head) AS first_head
    FROM inc GROUP BY station"""
)
def filtered_aggs(spark: SparkSession, d: str) -> DataFrame:
    return incidents(spark, d).groupBy("station").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("stage") == "O").alias("n_open"),
        S.half_up(F.sum(F.when(F.col("stage") == "F", F.col("amount"))), 0).alias("closed_amount"),
        F.bool_and(F.col("amount") > 0).alias("all_positive"),
        F.count_distinct("head").alias("n_heads"),
        F.min("head").alias("first_head"),
    )


@query(
    INCIDENTS
    + f""", a AS (SELECT *, year(registered_on) AS y, CASE WHEN stage <> 'F' THEN date_diff('day', registered_on, DATE '{WINDOW_END}') END AS days FROM inc WHERE registered_on <= DATE '{WINDOW_END}'),
    b AS (SELECT *, CASE WHEN days IS NULL THEN NULL WHEN days < 90 THEN '0-3m' WHEN days < 180 THEN '3-6m' WHEN days < 365 THEN '6-12m' WHEN days < 730 THEN '1-2y' ELSE '2y+' END AS age FROM a)
    SELECT 'stage' AS dimension_type, stage, NULL::VARCHAR AS station, NULL::INT AS fir_year, NULL::VARCHAR AS age_bucket, count(*) AS record_count FROM b GROUP BY stage
    UNION ALL SELECT 'year', stage, NULL, y, NULL, count(*) FROM b GROUP BY stage, y
    UNION ALL SELECT 'station', stage, station, NULL, NULL, count(*) FROM b GROUP BY stage, station
    UNION ALL SELECT 'ageing', NULL, station, NULL, age, count(*) FROM b WHERE age IS NOT NULL GROUP BY station, age
    UNION ALL SELECT 'modelled_flow', w[i], w[i + 1], NULL, NULL, count(*) FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT CASE stage {" ".join(f"WHEN '{k}' THEN {list(v)!r}" for k, v in _WAYS.items())} END AS w FROM b)) GROUP BY w[i], w[i + 1]"""
)
def justice_cube(spark: SparkSession, d: str) -> DataFrame:
    days = F.when(F.col("stage") != "F", F.datediff(F.lit(WINDOW_END).cast("date"), "registered_on"))
    inc = incidents(spark, d).filter(F.col("registered_on") <= F.lit(WINDOW_END).cast("date"))
    inc = inc.select("stage", "station", F.year("registered_on").alias("fir_year"), F.when(days.isNotNull(), S.age_bucket(days)).alias("age_bucket"))
    # All four cuts come out of one aggregate of the finest cells.
    cells = inc.groupBy("stage", "station", "fir_year", "age_bucket").agg(F.count("*").alias("n"))
    stage, station, year, age = (F.col(c) for c in ("stage", "station", "fir_year", "age_bucket"))
    cube = cells.groupingSets([(stage,), (stage, year), (stage, station), (station, age)], stage, station, year, age).agg(F.grouping_id().alias("g"), F.sum("n").alias("record_count"))
    kind = F.when(F.col("g") == 7, "stage").when(F.col("g") == 5, "year").when(F.col("g") == 3, "station").otherwise("ageing")
    cube = cube.select(kind.alias("dimension_type"), "stage", "station", "fir_year", "age_bucket", "record_count").filter("dimension_type <> 'ageing' OR age_bucket IS NOT NULL")
    # The fifth branch is modelled: each stage's cases went the way to it.
    way = F.element_at(F.create_map(*[x for k, v in _WAYS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), stage)
    steps = F.arrays_zip(F.slice(way, 1, F.size(way) - 1).alias("a"), F.slice(way, 2, F.size(way) - 1).alias("b"))
    flow = cells.groupBy("stage").agg(F.sum("n").alias("n")).select("n", F.explode(steps).alias("e")).groupBy("e.a", "e.b").agg(F.sum("n").alias("record_count"))
    none = lambda t: F.lit(None).cast(t)
    return cube.unionByName(flow.select(F.lit("modelled_flow").alias("dimension_type"), F.col("a").alias("stage"), F.col("b").alias("station"), none("int").alias("fir_year"), none("string").alias("age_bucket"), "record_count"))


@query(INCIDENTS + ", c AS (SELECT station, head, count(*) AS n FROM inc GROUP BY ALL) SELECT station, head, n FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY n DESC, head) AS r FROM c) WHERE r = 1")
def top1_per_group(spark: SparkSession, d: str) -> DataFrame:
    counts = incidents(spark, d).groupBy("station", "head").agg(F.count("*").alias("n"))
    return R.top_per_group(counts, ["station"], [F.col("n").desc(), F.col("head")])


@query(
    INCIDENTS
    + """, c AS (SELECT station, count(*) AS n FROM inc GROUP BY station), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, station) AS r FROM c)
    SELECT CASE WHEN r <= 8 THEN station ELSE 'Other' END AS station, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1"""
)
def topn_other(spark: SparkSession, d: str) -> DataFrame:
    return R.top_or_other(incidents(spark, d).groupBy("station").agg(F.count("*").alias("n")), "station", "n", 8)


@query("""WITH c AS (SELECT l_suppkey AS k, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY v, k) AS i FROM c)
    SELECT floor((2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*)) * 1e9 + 0.5) / 1e9 AS gini FROM r""")
def gini(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    return R.gini(by, "k", "v").select(S.half_up(F.col("gini"), 9).alias("gini"))


@query("""SELECT p_type, s[least(len(s), CAST(floor(0.9 * len(s)) AS INT) + 1)] AS p90, med, p95 FROM
    (SELECT p_type, list_sort(list(p_retailprice)) AS s, median(p_retailprice) AS med, quantile_cont(p_retailprice, 0.95) AS p95 FROM part GROUP BY p_type)""")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    v, rows = F.col("p_retailprice"), table(spark, d, "part")
    exact = rows.groupBy("p_type").agg(F.median(v).alias("med"), F.percentile(v, 0.95).alias("p95"))
    return R.nearest_rank(rows, ["p_type"], "p_retailprice", 0.9, "p90").join(exact, "p_type")


@query(
    INCIDENTS
    + f"SELECT station, floor(sum(pow(0.5, date_diff('day', registered_on, DATE '{WINDOW_END}') / 365.25)) * 1e6 + 0.5) / 1e6 AS weighted FROM inc WHERE registered_on <= DATE '{WINDOW_END}' GROUP BY station"
)
def recency_weighted(spark: SparkSession, d: str) -> DataFrame:
    end = F.lit(WINDOW_END).cast("date")
    inc = incidents(spark, d).filter(F.col("registered_on") <= end)
    return inc.groupBy("station").agg(S.half_up(F.sum(F.pow(F.lit(0.5), F.datediff(end, "registered_on") / 365.25)), 6).alias("weighted"))


@query("""WITH t AS (SELECT unnest(list_distinct(string_split_regex(upper(p_name), '[^A-Z]+'))) AS token FROM part)
    SELECT token, count(*) AS n FROM t WHERE length(token) >= 3 GROUP BY token ORDER BY n DESC, token LIMIT 200""")
def vocabulary_top(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "part").select(F.explode(F.array_distinct(F.split(F.upper("p_name"), "[^A-Z]+"))).alias("token"))
    return tokens.filter(F.length("token") >= 3).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(200)


@query(
    INCIDENTS
    + """, c AS (SELECT station, head, date_trunc('week', registered_on)::DATE AS week_start, count(*) AS n FROM inc GROUP BY ALL), ends AS (SELECT min(week_start) AS a, max(week_start) AS b FROM c),
    dense AS (SELECT station, head, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week_start FROM (SELECT DISTINCT station, head FROM c), ends)
    SELECT station, head, week_start, array_to_string(list(coalesce(n, 0)) OVER (PARTITION BY station, head ORDER BY week_start ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), ',') AS history FROM dense LEFT JOIN c USING (station, head, week_start)"""
)
def history_13(spark: SparkSession, d: str) -> DataFrame:
    by = W.partitionBy("station", "head").orderBy("week_start").rowsBetween(-12, 0)
    rows = weekly_counts(incidents(spark, d))
    return rows.select("station", "head", "week_start", F.array_join(F.collect_list(F.col("fir_count").cast("string")).over(by), ",").alias("history"))


_BASELINE = (
    INCIDENTS
    + """, c AS (SELECT station, head, date_trunc('week', registered_on)::DATE AS week_start, count(*) AS n FROM inc GROUP BY ALL),
    ends AS (SELECT min(week_start) AS a, max(week_start) AS b FROM c),
    spine AS (SELECT station, head, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week_start FROM (SELECT DISTINCT station, head FROM c), ends),
    dense AS (SELECT station, head, week_start, coalesce(n, 0) AS x, strftime(week_start, '%G-W%V') AS iso_week FROM spine LEFT JOIN c USING (station, head, week_start)),
    w AS (
      SELECT *, count(x) OVER p AS k, CAST(coalesce(sum(x) OVER p, 0) AS BIGINT) AS s, CAST(coalesce(count(x) OVER p * sum(x * x) OVER p - sum(x) OVER p * sum(x) OVER p, 0) AS BIGINT) AS nvar,
        list(x::DOUBLE) OVER (PARTITION BY station, head ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        avg(x) OVER (PARTITION BY station, head) AS whole, avg(x) OVER (PARTITION BY station, head, iso_week[7:8]) AS season
      FROM dense WINDOW p AS (PARTITION BY station, head ORDER BY week_start ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)
    ), v AS (
      SELECT *, CASE WHEN k > 0 THEN s / k ELSE 0 END AS mu, CASE WHEN k > 0 THEN nvar / (k * k) ELSE 0 END AS var, CASE WHEN whole > 0 THEN season / whole ELSE 1 END AS si,
        CASE WHEN len(before) > 0 THEN list_reduce(before, lambda a, y: 0.25::DOUBLE * y + 0.75::DOUBLE * a) END AS old FROM w
    ), y AS (SELECT *, coalesce(old, 0) * si AS e, CASE WHEN old IS NULL THEN x::DOUBLE ELSE 0.25::DOUBLE * x + 0.75::DOUBLE * old END AS ewma FROM v    ), r AS (SELECT *, CASE WHEN nvar > k * s AND s > 0 THEN s * s / (nvar - k * s) END AS disp FROM y),
    z AS (SELECT *, e + CASE WHEN disp IS NOT NULL THEN e * e / disp ELSE 0 END AS spread FROM r),
    q AS (
      SELECT e, disp, min(k) AS ucl FROM (
        SELECT e, disp, k, sum(exp(CASE WHEN disp IS NULL OR disp > 1e6 THEN k * ln(e) - e - lgamma(k + 1) ELSE lgamma(k + disp) - lgamma(disp) - lgamma(k + 1) + disp * ln(disp / (disp + e)) + k * ln(e / (disp + e)) END)) OVER (PARTITION BY e, disp ORDER BY k) AS share
        FROM (SELECT DISTINCT e, disp FROM r WHERE e > 0), range(400) t(k)
      ) WHERE share >= 0.99 GROUP BY e, disp
    )
    SELECT station, head, week_start, iso_week, x AS fir_count, k AS window_observations, floor(mu * 1e6 + 0.5) / 1e6 AS mean_52, floor(var * 1e6 + 0.5) / 1e6 AS variance_52,
      floor((ewma + 1e-9::DOUBLE) * 1e6 + 0.5) / 1e6 AS ewma, floor((z.e + 1e-9::DOUBLE) * 1e6 + 0.5) / 1e6 AS expected_count, floor(si * 1e6 + 0.5) / 1e6 AS seasonality_index,
      floor(z.disp * 1e6 + 0.5) / 1e6 AS dispersion_r, floor(CASE WHEN spread > 0 THEN (x - z.e) / sqrt(spread) ELSE x END * 1e6 + 0.5) / 1e6 AS z_score, coalesce(ucl, 0) AS ucl_99
    FROM z LEFT JOIN q ON q.e = z.e AND q.disp IS NOT DISTINCT FROM z.disp"""
)


@query(_BASELINE)
def weekly_baseline(spark: SparkSession, d: str) -> DataFrame:
    return baselines(incidents(spark, d))


@query("WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000) (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k FROM a)")
def symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return R.symmetric_difference(a, table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k")))


@query("SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS iso_week, dayofweek(o_orderdate) AS dow, date_trunc('month', o_orderdate)::DATE AS month FROM orders")
def calendar_parts(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", S.iso_week(day).alias("iso_week"), (F.dayofweek(day) - 1).cast("long").alias("dow"), F.to_date(F.date_trunc("month", day)).alias("month"))


@query("SELECT doc_id, k AS part, substr(text, CAST(k * 255 + 1 AS BIGINT), 255) AS said FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 255.0) AS BIGINT))) AS k FROM documents)")
def chunk_255(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(S.chunks(F.col("text"))).alias("part", "said"))
    return rows.select("doc_id", F.col("part").cast("long").alias("part"), "said")


def _hmac(message: str) -> str:
    block = H.SEED.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@query(
    f"WITH h AS (SELECT s_suppkey, {_hmac("'1|slot|' || s_suppkey || '|unit'")} AS h FROM supplier) SELECT s_suppkey, CAST(CAST('0x' || substr(h, 1, 16) AS UBIGINT) % 1000000 AS BIGINT) AS slot, "
    "floor(CAST(CAST('0x' || substr(h, 1, 16) AS UBIGINT) >> 11 AS DOUBLE) / 9007199254740992.0 * 1e9 + 0.5) / 1e9 AS draw FROM h"
)
def stable_index(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    return table(spark, d, "supplier").select("s_suppkey", H.stable_index("slot", key, "unit", 1_000_000).alias("slot"), S.half_up(H.unit_draw("slot", key, "unit"), 9).alias("draw"))


@query("""WITH e AS (SELECT event_type, CAST(hour(ts) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT h, sum(n) AS n FROM e GROUP BY h),
    s AS (SELECT event_type, h FROM (SELECT DISTINCT event_type FROM e), range(24) t(h)), tot AS (SELECT sum(n) AS n FROM g), per AS (SELECT event_type, sum(n) AS n FROM e GROUP BY 1)
    SELECT s.event_type, s.h AS hour, floor((coalesce(e.n, 0) + 48 * coalesce(g.n, 0) / tot.n) / (per.n + 48) * 1e9 + 0.5) / 1e9 AS share
    FROM s LEFT JOIN e USING (event_type, h) LEFT JOIN g ON g.h = s.h JOIN per ON per.event_type = s.event_type, tot""")
def time_model_fit(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("event_type", F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    spine = counts.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    dense = spine.join(counts, ["event_type", "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    at_hour, of_type, all_ = (F.sum("n").over(W.partitionBy(*k)) for k in (["hour"], ["event_type"], []))
    return dense.select("event_type", "hour", S.half_up((F.col("n") + 48 * at_hour / all_) / (of_type + 48), 9).alias("share"))


@query("""SELECT a.vec_id AS target, b.vec_id AS candidate, r FROM (
      SELECT t.vec_id AS a, c.vec_id AS b, row_number() OVER (PARTITION BY t.vec_id ORDER BY round(list_cosine_similarity(t.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) DESC, c.vec_id) AS r
      FROM embeddings t JOIN embeddings c ON t.label = c.label AND t.vec_id <> c.vec_id WHERE t.vec_id % 50 = 0) x
    JOIN embeddings a ON a.vec_id = x.a JOIN embeddings b ON b.vec_id = x.b WHERE r <= 10""")
def similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")

    def scores(x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray]:
        c = cosines(matrix(x["embedding"]), matrix(y["embedding"])) * 1e6
        return (np.trunc(c + np.copysign(0.5, c)) / 1e6,)

    return nearest(rows, "id % 50 = 0", scores, 10).select("target", "candidate", "r")
