"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word rules: space, tab, \n, \v, \f, \r.
SPACES = "[\\x20\\x09-\\x0D]+"
WORDS = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def nested(df: DataFrame, **more: Column) -> DataFrame:
    """Each row of df as one struct `row`, beside columns of an operator's own: no names can clash. more: made from `row`."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return rows.select("row", *[c.alias(name) for name, c in more.items()])


def unnested(df: DataFrame, columns: list[str], **more: Column) -> DataFrame:
    """The rows that `nested` took in, with columns added or replaced."""
    kept = [more.pop(c).alias(c) if c in more else F.col("row").getField(c).alias(c) for c in columns]
    return df.select(*kept, *[x.alias(name) for name, x in more.items()])


def worker_cache(key: Any, make: Callable[[], Any]) -> Any:
    """make(), once for each Python worker process."""
    held = sys.__dict__.setdefault("_wardline_held", {})
    if key not in held:
        held[key] = make()
    return held[key]
