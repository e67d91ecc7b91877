"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine c lie at squared distance 2 - 2c. A seeded rotation spreads that evenly; the rotated
coordinates are split into blocks, of each length of vectors its own. If two vectors lie within the whole
budget, in one block at least they
lie within the block's proportional share of it. Each block is range-joined: a grid on its first coordinates
has cells wider than the block's radius, a vector goes to its own cell and, where it lies within the radius of a
lower border, to the cell below, so that each close pair meets in exactly one cell that both were sent to
as the lower corner of the two. In that cell pairs are checked exactly, in double precision, on the original
vectors, and a pair counts only in the first block that could have found it: the union over blocks needs no
list of pairs, only counts and a spanning forest leave a cell.

Equal vectors are merged first, by 128 bits of a digest, and numbered; their copies count as links and never
meet. Cells with over `most` vectors are split into parts that meet pairwise, each pair of parts a task of its
own: for a hot cell the comparisons stay quadratic, but none of its tasks grows.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a null
label, link with nothing and are kept; vectors of different lengths don't link; an empty table gives an empty
result; other columns are ignored. A repeated
vec_id is one vector per row; its rows share the id in the result. Very long vectors are joined like others: a
worker holds one rotation for each length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import worker_cache
from wardline.operators.components import connected_components
from wardline.sources.scratch import Store

SEED = 7
#: Rounding may not lose a pair, so budgets are wider by this share.
SLACK = 1e-6


def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Frame:
    """The rotation, blocks, radii and cell widths for vectors of one length."""

    def __init__(self, dim: int, threshold: float, blocks: int, grid: int):
        self.q = rotation(dim)
        self.ends = np.unique(np.linspace(0, dim, min(blocks, dim) + 1).astype(int))
        sizes = np.diff(self.ends)
        self.share = budget(threshold) * sizes / dim
        self.radius = np.sqrt(self.share)
        self.grid = np.minimum(grid, sizes)

    def __len__(self) -> int:
        return len(self.share)

    def at(self, y: np.ndarray, b: int) -> np.ndarray:
        """Grid coordinates of rotated vectors in a block, in cells."""
        return y[:, self.ends[b] : self.ends[b] + self.grid[b]] / (2 * self.radius[b])


def frame(dim: int, threshold: float, blocks: int, grid: int) -> Frame:
    return worker_cache(("frame", dim, threshold, blocks, grid), lambda: Frame(dim, threshold, blocks, grid))


def budget(threshold: float) -> float:
    return (2 - 2 * threshold) * (1 + SLACK) + 1e-12


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, key (of a vector's exact components; null if it can't link), v (its bytes as doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = [], []
            for x, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                v = np.array([math.nan if c is None else c for c in x], np.float64) + 0.0 if x and label is not None else None
                good = v is not None and np.isfinite(v).all() and v.any()
                data.append(v.tobytes() if good else None)
                keys.append(hashlib.blake2b(data[-1], digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "label", "key", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    return rows.mapInArrow(run, "vec_id long, label string, key binary, v binary")


def _unit(data: list[bytes]) -> np.ndarray:
    v = np.stack([np.frombuffer(x, np.float64) for x in data])
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of tiny and huge components stay in range
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cells(classes: DataFrame, threshold: float, blocks: int, grid: int) -> DataFrame:
    """(id, n, label, dim, block, cell, v) for each cell a vector goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(3).to_pylist()
            dims = np.array([len(x) // 8 for x in data], np.int64)
            take, dim, block, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                fr = frame(d, threshold, blocks, grid)
                y = _unit([data[i] for i in rows]) @ fr.q.T
                for b in range(len(fr)):
                    z = fr.at(y, b)
                    at = np.floor(z).astype(np.int64)
                    near = z - at <= 0.5 + 1e-9
                    for mask in range(1 << z.shape[1]):
                        down = np.array([mask >> g & 1 for g in range(z.shape[1])], bool)
                        sent = np.flatnonzero(near[:, down].all(axis=1))
                        take.append(rows[sent])
                        dim.append(np.full(len(sent), d))
                        block.append(np.full(len(sent), b))
                        cell += [",".join(map(str, c)) for c in (at[sent] - down).tolist()]
            where = pa.array(np.concatenate(take), pa.int64())
            cols = [batch.column(k).take(where) for k in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(dim), pa.int32()), pa.array(np.concatenate(block), pa.int32()), pa.array(cell, pa.string()), batch.column(3).take(where)], ["id", "n", "label", "dim", "block", "cell", "v"])

    return classes.select("id", "n", "label", "v").mapInArrow(run, "id long, n long, label string, dim int, block int, cell string, v binary")


def _joined(threshold: float, blocks: int, grid: int):  # noqa: ANN202
    """The check of one cell, or of two parts of a large one: counts and a forest."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["id", "n", "part"]).to_pydict()
        data = group.column("v").to_pylist()
        dim, b, cell, first, second = (group.column(k)[0].as_py() for k in ("dim", "block", "cell", "first", "second"))
        ids, n, part = np.array(rows["id"]), np.array(rows["n"]), np.array(rows["part"])
        fr = frame(dim, threshold, blocks, grid)
        u = _unit(data)
        y = u @ fr.q.T
        at = np.floor(fr.at(y, b)).astype(np.int64)
        corner = np.array(list(map(int, cell.split(","))))
        left, right = np.flatnonzero(part == first), np.flatnonzero(part == second)
        links, root = np.zeros(len(ids), np.int64), list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for s in range(0, len(left), 512):
            i = left[s : s + 512]
            hit = u[i] @ u[right].T >= threshold
            hit &= i[:, None] < right[None, :] if first == second else True
            ps, rs = (side[x] for side, x in zip((i, right), np.nonzero(hit)))
            for k in range(0, len(ps), 16384):
                p, r = ps[k : k + 16384], rs[k : k + 16384]
                # A pair belongs to the cell that is the lower corner of its two, in the first block that finds it.
                mine = (np.minimum(at[p], at[r]) == corner).all(axis=1)
                p, r = p[mine], r[mine]
                close = np.add.reduceat((y[p] - y[r]) ** 2, fr.ends[:-1], axis=1) <= fr.share
                first_found = close[:, b] & ~close[:, :b].any(axis=1)
                p, r = p[first_found], r[first_found]
                np.add.at(links, p, n[r])
                np.add.at(links, r, n[p])
                for x, z in zip(p.tolist(), r.tolist()):
                    x, z = find(x), find(z)
                    if x != z:
                        root[x] = z
        some = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array([ids[find(i)] for i in some], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, blocks: int = 8, grid: int = 2, most: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors (vec_id, embedding, label). The result reads a table of the shared folder."""
    store = Store(vectors.sparkSession)
    rows = store.cut(keyed(vectors), "vectors")
    # Classes of equal vectors: their copies are at cosine 1.
    able = rows.filter("key IS NOT NULL")
    classes = able.groupBy("label", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = store.cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    spots = store.cut(cells(classes, threshold, blocks, grid), "cells")
    cell = ["label", "dim", "block", "cell"]
    many = spots.groupBy(*cell).count().filter(F.col("count") > most)
    many = many.select(*cell, F.ceil(F.col("count") / most).cast("int").alias("parts"))
    spread = spots.join(many, cell, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spread = spread.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.withColumn("first", F.least("part", "other")).withColumn("second", F.greatest("part", "other"))
    found = spread.groupBy(*cell, "first", "second").applyInArrow(_joined(threshold, blocks, grid), "id long, links long, root long")
    found = store.cut(found, "links")
    store.drop(spots)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), store)
    by = classes.select("label", "key", "id", "least", "n").join(links, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    by = store.cut(by.withColumn("comp", F.coalesce("component", "id")).select("label", "key", "n", "links", "least", "comp"), "joined")
    least = by.groupBy("comp").agg(F.min("least").alias("component_id"))
    by = by.join(least, "comp").select("label", "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id")
    out = rows.select("vec_id", "label", "key").join(by, ["label", "key"], "left")
    component = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
    out = store.cut(out, "vectors-linked")
    store.close(out)
    return out
