"""Mixing sources to target weights.

Tokens are summed per source, a repetition rate follows from each source's target, and a document is
taken floor(rate) times plus once more with probability rate - floor(rate), drawn from a keyed hash of
its id, its source, its text and its number among the rows that share all three. Those rows are numbered in the order
of a digest of all their columns, so only rows that don't differ at all may swap: partitioning and reruns change nothing.

Targets share `share` of all tokens by weight; none passes `cap` times its source's size, and what is
cut off is shared again by weight. That fixed point is found in closed form: with sources ordered by
cap * size / weight, a prefix of them is capped and the rest get one level times their weight. Ranks and
prefix sums over sources are taken by ranges, so that sources may be many.

Defined results: null text has size 0; a null source is a source of its own, last in the order; repeated
rows are separate documents with draws of their own; null ids and texts draw like empty ones; sources
without a token have target 0 and rate 0; very long texts count whole; an empty table gives an empty result.
Columns of the input are kept by `mix`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.llm.common import WORDS, nested, unnested
from wardline.operators.ordered import running
from wardline.sources.scratch import Store

#: Rows that repeat an id and a text are numbered in so many parts.
PARTS = 64


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def targets(sized: DataFrame, store: Store, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, size) rows -> source, source_size, target, rate; one row per source."""
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by = running(by, [F.col("source").asc_nulls_last()], {}, store, "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("place") - 1) % len(weights)).cast("int") + 1)
    by = by.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by = running(by, [(F.col("most") / F.col("w")).asc(), F.col("place")], {"most_upto": F.col("most"), "w_upto": F.col("w")}, store)
    by = store.cut(by, "ranked")
    whole = by.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w"))
    by = by.withColumn("all_size", whole.select("size").scalar()).withColumn("all_w", whole.select("w").scalar())
    # Before this row all are capped: what is left of the total, over the weights from here on.
    level = (F.col("all_size") * F.lit(float(share)) - (F.col("most_upto") - F.col("most"))) / (F.col("all_w") - F.col("w_upto") + F.col("w"))
    by = store.cut(by.withColumn("level", level), "levels")
    # The first row whose share is below its cap has the level that holds for it and all after it.
    first = by.filter(F.col("level") * F.col("w") <= F.col("most")).agg(F.min(F.struct("rank", "level")).alias("open"))
    by = by.withColumn("open", first.scalar())
    held = F.coalesce(F.col("rank") < F.col("open.rank"), F.lit(True))
    target = F.when(held, F.col("most")).otherwise(F.least(F.col("most"), F.col("open.level") * F.col("w"))).cast("double")
    return by.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def copies_of(rate: Column, key: Column, number: Column, seed: int) -> Column:
    """floor(rate) and one more where the uniform draw of the key and number is below the fraction."""
    said = F.sha2(F.concat_ws(":", F.lit(str(seed)), key, number.cast("string")), 256)
    draw = F.conv(F.substring(said, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def numbered(rows: DataFrame, store: Store) -> DataFrame:
    """rows (key, same, ...) with `number`, from 0 within each key in the order of `same`; hot keys are counted in parts, none in one task."""
    rows = store.cut(rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), "parts")
    count = rows.groupBy("key", "same", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("same", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    count = count.select("key", "same", "part", before.alias("before"))
    # Rows of one `same` are equal in every column: which of them has which number can't be told.
    at = F.row_number().over(W.partitionBy("key", "same", "part").orderBy(F.lit(0))) - 1
    return rows.withColumn("at", at).join(count, ["key", "same", "part"]).withColumn("number", (F.col("at") + F.col("before")).cast("long")).drop("at", "before", "part")


def _drawn(rows: DataFrame, keys: DataFrame, store: Store) -> DataFrame:
    """rows (key, same, ...) with `number`; only rows whose key `keys` has several times are moved."""
    again = store.cut(keys.groupBy("key").count().filter("count > 1").select("key"), "again")
    once = rows.join(again, "key", "left_anti").withColumn("number", F.lit(0).cast("long"))
    return once.unionByName(numbered(rows.join(again, "key", "left_semi"), store)).drop("same")


def _key(doc_id: Column, source: Column, text: Column) -> Column:
    said = [F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, source, text)]
    return F.sha2(F.concat_ws("|", said[0], F.length(said[1]).cast("string"), said[1], said[2]), 256)


def plan(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 20240) -> DataFrame:
    """doc_id, size, source_size, target, copies: a row per document. Texts are read once; only sizes are shuffled."""
    store = Store(docs.sparkSession)
    key = _key(F.col("doc_id"), F.col("source"), F.col("text"))
    # Nothing but id, source and text counts here.
    sized = store.cut(docs.select("doc_id", "source", key.alias("key"), F.lit(0).alias("same"), size_of(F.col("text")).alias("size")), "sizes")
    goal = targets(sized, store, weights, share, cap)
    # Sources may be many: the side is broadcast only if its size, known once it is there, is small.
    joined = _drawn(sized, sized, store).alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    out = joined.select("d.doc_id", "d.size", "g.source_size", "g.target", copies_of(F.col("g.rate"), F.col("d.key"), F.col("d.number"), seed).alias("copies"))
    out = store.cut(out, "plan")
    store.close(out)
    return out


def mix(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 20240) -> DataFrame:
    """The mixed corpus: the columns of docs, a row for every copy taken. The result reads small tables of the shared folder."""
    store = Store(docs.sparkSession)
    sized = store.cut(docs.select("source", _key(F.col("doc_id"), F.col("source"), F.col("text")).alias("key"), size_of(F.col("text")).alias("size")), "sizes")
    goal = store.cut(targets(sized, store, weights, share, cap), "targets")
    rows = nested(docs, key=_key(F.col("row.doc_id"), F.col("row.source"), F.col("row.text")), same=F.xxhash64("row"), source=F.col("row.source"))
    joined = _drawn(rows, sized, store).alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    taken = joined.select("d.row", copies_of(F.col("g.rate"), F.col("d.key"), F.col("d.number"), seed).alias("copies")).filter("copies > 0")
    return unnested(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")), docs.columns)
