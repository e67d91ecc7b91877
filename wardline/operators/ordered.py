"""Ranks and running sums over all rows in one order, without one task for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.sources.scratch import Store


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], store: Store, rank: str = "rank") -> DataFrame:
    """df with the place of each row in the order, from 1, and sums over the rows up to it.

    Rows are dealt out by ranges of the order; each range is summed on its own, and a range's offset is the
    total of those before it: one row for each partition, whatever the number of rows. Ties of the whole order
    are placed in any order. The result belongs to the store.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    values = {f"_sum_{name}": value for name, value in sums.items()}
    dealt = df.select("*", *[v.alias(k) for k, v in values.items()]).repartitionByRange(parts, *order)
    dealt = store.cut(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    whole = dealt.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(k).alias(f"{k}_all") for k in values])
    # As many rows as partitions.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = whole.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *[F.coalesce(F.sum(f"{k}_all").over(before), F.lit(0)).alias(f"{k}_before") for k in values])
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # One row of offsets for each partition: the broadcast's size is bounded by the number of partitions.
    out = dealt.withColumn("_row", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    for k in values:
        out = out.withColumn(f"{k}_upto", F.sum(k).over(within))
    out = out.join(F.broadcast(offsets), "_part")
    made = [(F.col(f"{k}_before") + F.col(f"{k}_upto")).alias(name) for k, name in zip(values, sums)]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_row")).cast("long").alias(rank), *made)
