"""Scans: parquet tables, and every table of a folder as a view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    """The incident fact: one row per order with its territory (nation, region), head, group, stage and day."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("incident_id"),
        F.col("n_name").alias("station"),
        F.col("r_name").alias("division"),
        F.col("o_orderpriority").alias("head"),
        F.col("c_mktsegment").alias("crime_group"),
        F.col("o_orderstatus").alias("stage"),
        F.to_date("o_orderdate").alias("registered_on"),
        F.col("o_totalprice").alias("amount"),
    )
