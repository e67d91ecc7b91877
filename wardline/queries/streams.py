"""Streams of clicks that arrive in parts, late and repeated, held to the batch that says the same."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalogue import _hmac, query
from wardline.functions import hashing as H
from wardline.functions.scalars import half_up
from wardline.sources.scratch import Store
from wardline.sources.tables import table
from wardline.streaming import streams

#: Clicks with a time and a kind, each once, and days of arrivals that come in one part.
_CLICKS = "c AS (SELECT DISTINCT click_id, ts, client_id, kind FROM clicks WHERE ts IS NOT NULL AND kind IS NOT NULL)"
_DAYS = 45


def _arrive(spark: SparkSession, d: str, step: streams.Step, name: str, idle: bool = True) -> DataFrame:
    rows = streams.clicks(table(spark, d, "clicks"))
    return streams.arrive(rows, F.floor(F.datediff("arrived_at", F.lit("2024-01-01")) / _DAYS), step, Store(spark), name, idle)


@query(f"WITH {_CLICKS} SELECT kind, date_trunc('week', ts)::DATE AS week, count(*) AS n FROM c GROUP BY ALL")
def stream_weekly_counts(spark: SparkSession, d: str) -> DataFrame:
    return _arrive(spark, d, streams.weekly, "weekly")


@query(f"WITH {_CLICKS} SELECT kind, count(*) AS n FROM c GROUP BY kind")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = _arrive(spark, d, streams.once, "once")
    return rows.filter("kind <> ''").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {_CLICKS}, g AS (SELECT client_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY client_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM c), s AS (SELECT *, sum(fresh) OVER (PARTITION BY client_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT client_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM s GROUP BY client_id, k""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return _arrive(spark, d, streams.sessions, "sessions").withColumn("began", F.date_format("began", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {_CLICKS}, w AS (SELECT kind, date_trunc('week', ts)::DATE AS week, count(*) AS n FROM c GROUP BY ALL),
    spine AS (SELECT kind, CAST(unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week FROM w GROUP BY kind),
    x AS (SELECT kind, week, coalesce(n, 0) AS n FROM spine LEFT JOIN w USING (kind, week)),
    p AS (SELECT *, count(n) OVER r AS k, CAST(coalesce(sum(n) OVER r, 0) AS BIGINT) AS s, CAST(coalesce(count(n) OVER r * sum(n * n) OVER r - sum(n) OVER r * sum(n) OVER r, 0) AS BIGINT) AS v,
      list(n::DOUBLE) OVER (PARTITION BY kind ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x WINDOW r AS (PARTITION BY kind ORDER BY week ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)),
    e AS (SELECT kind, week, n, CASE WHEN len(before) > 0 THEN list_reduce(before, lambda a, y: 0.25::DOUBLE * y + 0.75::DOUBLE * a) ELSE 0 END AS e, CASE WHEN v > k * s AND s > 0 THEN s * s / (v - k * s) END AS d FROM p),
    q AS (SELECT e, d, min(k) AS ucl FROM (SELECT e, d, k, sum(exp(CASE WHEN d IS NULL OR d > 1e6 THEN k * ln(e) - e - lgamma(k + 1) ELSE lgamma(k + d) - lgamma(d) - lgamma(k + 1) + d * ln(d / (d + e)) + k * ln(e / (d + e)) END)) OVER (PARTITION BY e, d ORDER BY k) AS share
      FROM (SELECT DISTINCT e, d FROM e WHERE e > 0), range(20000) t(k) WHERE k < 3 * e + 200) WHERE share >= 0.99 GROUP BY e, d)
    SELECT kind, week, n, floor((e.e + 1e-9::DOUBLE) * 1e6 + 0.5) / 1e6 AS expected, coalesce(ucl, 0) AS ucl_99, n >= 5 AND n > coalesce(ucl, 0) AS alert FROM e LEFT JOIN q ON q.e = e.e AND q.d IS NOT DISTINCT FROM e.d""")
def stream_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = _arrive(spark, d, streams.monitored, "limits")
    return rows.withColumn("expected", half_up(F.col("expected") + 1e-9, 6)).withColumn("alert", (F.col("n") >= 5) & (F.col("n") > F.col("ucl_99")))


@query("SELECT DISTINCT coalesce(client_id::VARCHAR, '') || '|' || kind AS key FROM clicks WHERE ts IS NOT NULL AND kind IS NOT NULL")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Each client and kind once while it is remembered: a day of the clock, longer than this runs."""
    key = F.concat_ws("|", F.coalesce(F.col("client_id").cast("string"), F.lit("")), "kind")
    return _arrive(spark, d, lambda rows: streams.first_seen(rows.select(key.alias("key"), "kind"), timedelta(days=1)), "first-seen", False)


_TICK = 6000


@query(f"SELECT CAST(ceil(ms / {_TICK}.0) AS BIGINT) AS number, id, ms AS replay_offset_ms FROM (SELECT o_orderkey AS id, CAST(CAST('0x' || substr({_hmac("'1|replay|' || o_orderkey || '|'")}, 1, 16) AS UBIGINT) % 60000 AS BIGINT) AS ms FROM orders WHERE o_orderpriority = '1-URGENT')")
def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders as a clock of eleven ticks makes them visible."""
    store = Store(spark)
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), H.stable_index("replay", key, "", 60_000).alias("replay_offset_ms"))
    rows = store.cut(rows, "replay-rows")
    at = store.path("ticks")
    for k in range(0, 11, 4):  # a few ticks at a time
        spark.range(k, min(k + 4, 11), 1, 1).select(F.col("id").alias("number")).write.mode("append").parquet(f"{at}/in")
        ticks = spark.readStream.schema("number long").parquet(f"{at}/in")
        said = streams.replayed(ticks, rows, _TICK)
        said.writeStream.option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(said.schema).parquet(f"{at}/out").select("number", "id", "replay_offset_ms")
