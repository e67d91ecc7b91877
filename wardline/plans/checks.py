"""Checks of tables against what is said of them; each gives rows to read, none stops by itself but `must`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claims(measured: dict[str, tuple[int | None, DataFrame]]) -> DataFrame:
    """claim, expected, measured, verdict; a claim without an expected value informs only. measured: one row, one column each."""
    rows = [df.select(F.lit(claim).alias("claim"), F.lit(expected).cast("int").alias("expected"), F.col(df.columns[0]).cast("long").alias("measured")) for claim, (expected, df) in measured.items()]
    verdict = F.when(F.col("expected").isNull(), "INFO").when(F.col("expected") == F.col("measured"), "PASS").otherwise("DRIFT")
    return reduce(DataFrame.unionByName, rows).withColumn("verdict", verdict)


def measures(rows: DataFrame, kind: str, amount: str) -> DataFrame:
    """name, value: the rows, those of each kind, and the amount, out of one aggregate."""
    by = rows.groupBy(kind).agg(F.count("*").alias("n"), F.sum(amount).alias("v"))
    whole = by.agg(F.sum("n").cast("double").alias("n"), F.floor(F.sum("v") + 0.5).cast("double").alias("v"))
    parts = by.select(F.concat(F.lit("stage "), F.col(kind)).alias("name"), F.col("n").cast("double").alias("value"))
    return parts.unionByName(whole.select(F.explode(F.create_map(F.lit("rows"), "n", F.lit("amount"), "v")).alias("name", "value")))


def reconciled(source: DataFrame, derived: DataFrame) -> DataFrame:
    """name, source, derived, same of two tables of measures."""
    both = source.withColumnRenamed("value", "source").join(derived.withColumnRenamed("value", "derived"), "name", "full")
    return both.select("name", "source", "derived", F.col("source").eqNullSafe(F.col("derived")).alias("same"))


def drift(rows: DataFrame, contract: dict[str, tuple[str, bool, int | None]]) -> DataFrame:
    """column_name, fault, n: columns missing, extra or of another type, mandatory values that are null, texts too long. contract: type, mandatory, length. One pass over the rows."""
    there = dict(rows.dtypes)
    faults = [(c, "missing", F.lit(1)) for c in contract if c not in there] + [(c, "extra", F.lit(1)) for c in there if c not in contract]
    for c, (kind, mandatory, longest) in contract.items():
        if c in there:
            faults += [(c, f"is {there[c]}", F.lit(1))] if there[c] != kind else []
            faults += [(c, "null", F.count_if(F.col(c).isNull()))] if mandatory else []
            faults += [(c, "too long", F.count_if(F.length(c) > longest))] if longest is not None else []
    found = rows.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(what).alias("fault"), n.cast("long").alias("n")) for c, what, n in faults]).alias("f"))
    return found.select(F.explode("f").alias("f")).select("f.*").filter("n > 0")


def orphans(rows: DataFrame, key: str, owners: DataFrame, owner: str) -> DataFrame:
    """orphan: keys that no owner has."""
    return rows.select(F.col(key).alias("orphan")).distinct().join(owners, F.col("orphan") == F.col(owner), "left_anti")


def lint(lines: DataFrame, column: str, rules: dict[str, str]) -> DataFrame:
    """rule, hits, dead: how many lines each pattern finds, and rules that find none. One pass."""
    found = lines.agg(F.array(*[F.struct(F.lit(rule).alias("rule"), F.count_if(F.col(column).rlike(pattern)).alias("hits")) for rule, pattern in rules.items()]).alias("r"))
    return found.select(F.explode("r").alias("r")).select("r.rule", "r.hits", (F.col("r.hits") == 0).alias("dead"))


def unexplained(rows: DataFrame) -> DataFrame:
    """Rows that were inferred or generated without a method."""
    return rows.filter(F.col("transformation").isin("inferred", "generated") & F.coalesce(F.trim("method") == "", F.lit(True)))


def must(rows: DataFrame, holds: Column, what: str) -> DataFrame:
    """rows, and an error when one is read for which this doesn't hold."""
    return rows.filter(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(what)).cast("boolean")))
