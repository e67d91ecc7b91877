"""Aggregates, ranks and set operations that several plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.operators.ordered import running
from wardline.sources.scratch import Store


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark filters by rank before the shuffle too."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def top_or_other(counts: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n largest keys and one row 'Other' for the rest."""
    top = counts.orderBy(F.col(value).desc(), F.col(key)).limit(n).select(F.col(key).alias("_top"))
    named = counts.join(F.broadcast(top), F.col(key) == F.col("_top"), "left")  # n rows
    return named.groupBy(F.coalesce("_top", F.lit("Other")).alias(key)).agg(F.sum(value).cast("long").alias(value))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionByName(b.subtract(a))


def gini(df: DataFrame, key: str, value: str) -> DataFrame:
    """(gini): of a column of one value per key; 0 for nothing. Ranks are taken by ranges. The result is made when this is called."""
    store = Store(df.sparkSession)
    ranked = running(df, [F.col(value), F.col(key)], {}, store, "_i")
    n, total = F.count("*"), F.sum(value)
    g = 2 * F.sum(F.col("_i") * F.col(value)) / (n * total) - (n + 1) / n
    out = store.cut(ranked.agg(F.coalesce(F.when(total != 0, g), F.lit(0.0)).alias("gini")), "gini")
    store.close(out)
    return out


def nearest_rank(df: DataFrame, keys: list[str], value: str, f: float, name: str) -> DataFrame:
    """keys, name: sorted[min(n - 1, floor(f * n))] of each group, from the counts of distinct values and their running sum."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    by = W.partitionBy(*keys)
    upto = F.sum("_n").over(by.orderBy(value))
    whole = F.sum("_n").over(by)
    ranked = counts.withColumn("_upto", upto).withColumn("_all", whole)
    at = F.least(F.col("_all") - 1, F.floor(F.lit(f) * F.col("_all")))
    return ranked.filter((F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at)).select(*keys, F.col(value).alias(name))


def tree_digest(rows: DataFrame, width: int, levels: int) -> DataFrame:
    """(n, digest) of rows (key, said) in order of whole-number keys: SHA-256 of each run of `width` keys, line by line, then of runs of those digests, `levels` in all, and of what is left. The last step has n / width ** levels rows."""
    by = rows.select(F.col("key").cast("long"), F.col("said").alias("h"), F.lit(1).cast("long").alias("n"))
    whole = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "h"))), lambda x: x["h"]), "\n"), 256)
    for _ in range(levels):
        by = by.groupBy(F.floor(F.col("key") / width).alias("up")).agg(whole.alias("h"), F.sum("n").alias("n")).withColumnRenamed("up", "key")
    return by.agg(F.sum("n").alias("n"), whole.alias("digest"))
