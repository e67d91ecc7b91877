"""The nearest vectors of each target within its label: blocks of targets against blocks of vectors, a matrix product for each two."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import wardline.sources.scratch  # noqa: F401  (functions travel whole)

#: Vectors of a block on either side, which bound a task's memory; a product is some 4 million scores.
TARGETS, VECTORS = 1000, 4000

#: scores(targets, vectors) -> (score, *others), matrices of a row for each target.
Scores = Callable[[pd.DataFrame, pd.DataFrame], tuple[np.ndarray, ...]]


def matrix(column: pd.Series) -> np.ndarray:
    """Vectors as rows in double precision; a null one has no numbers, and no score."""
    wide = max((len(x) for x in column if x is not None), default=0)
    return np.stack([np.full(wide, np.nan) if x is None else np.asarray(x, np.float64) for x in column])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 for two zero vectors, 0 for one."""
    a, b = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    both = a[:, None] * b[None, :]
    out = np.divide(x @ y.T, both, out=np.zeros_like(both), where=both != 0)
    out[np.ix_(a == 0, b == 0)] = 1.0
    return out


def nearest(rows: DataFrame, chosen: str, scores: Scores, n: int, others: tuple[str, ...] = ()) -> DataFrame:
    """(target, candidate, score, *others, r): the n rows (id, label, ...) of each target's label with the highest score, itself left out; ties go to the least id. chosen: which rows are targets.

    Labels are dealt out in blocks of bounded size by a hash of the id, and each block of targets meets each block of
    its label, so that no label meets in one task. A task keeps n rows of each target; all scores are worked out.
    """
    rows = rows.filter("label IS NOT NULL")
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("_parts"), F.ceil(F.count_if(F.expr(chosen)) / TARGETS).cast("int").alias("_of"))
    dealt = rows.join(sizes.filter("_of > 0"), "label")
    part = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    every = lambda count, c: F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(c)
    columns = [c for c in rows.columns if c != "label"]
    # Both sides come of the same rows: names of their own keep them apart.
    targets = dealt.filter(chosen).select(F.col("label").alias("of"), part("_of").alias("t"), every("_parts", "v"), *[F.col(c).alias(f"x_{c}") for c in columns])
    vectors = dealt.select("label", part("_parts").alias("v"), every("_of", "t"), *columns)

    def best(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(x) or not len(y):
            return pd.DataFrame({c: [] for c in ("target", "candidate", "score", *others)})
        x, y = x.rename(columns=lambda c: c.removeprefix("x_")), y.sort_values("id", ignore_index=True)
        score, *more = scores(x, y)
        ids, out = y["id"].to_numpy(), []
        for i, target in enumerate(x["id"].to_numpy()):
            at = np.flatnonzero(ids != target)
            # Ids ascend, and the sort is stable: ties go to the least.
            at = at[np.argsort(-score[i, at], kind="stable")[:n]]
            out.append(pd.DataFrame({"target": target, "candidate": ids[at], "score": score[i, at], **{c: m[i, at] for c, m in zip(others, more)}}))
        return pd.concat(out)

    kind = dict(rows.dtypes)["id"]
    schema = ", ".join([f"target {kind}", f"candidate {kind}", *[f"{c} double" for c in ("score", *others)]])
    found = targets.groupBy("of", "t", "v").cogroup(vectors.groupBy("label", "t", "v")).applyInPandas(best, schema)
    rank = F.row_number().over(W.partitionBy("target").orderBy(F.col("score").desc(), "candidate"))
    return found.withColumn("r", rank.cast("long")).filter(F.col("r") <= n)
