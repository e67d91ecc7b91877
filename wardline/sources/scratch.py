"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import wardline

# Functions sent to executors travel whole, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(wardline)


Query = Callable[..., DataFrame]
#: Paths of this process under the shared folder that haven't been deleted.
made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without that setting a temporary one, on a single machine only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{tempfile.gettempdir()}/wardline-shared"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made.add(path)
    return path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete paths of the shared folder."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        made.discard(path)


def tidy(query: Query) -> Query:
    """The query, which deletes what it wrote to the shared folder if it fails."""

    @functools.wraps(query)
    def run(spark: SparkSession, *rest: Any, **more: Any) -> DataFrame:
        before = set(made)
        try:
            return query(spark, *rest, **more)
        except BaseException:
            forget(spark, *(made - before))
            raise

    return run


class Store:
    """The intermediate tables of one operator; what isn't kept goes when it is closed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def path(self, name: str) -> str:
        self.paths.append(scratch(self.spark, name))
        return self.paths[-1]

    def cut(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """df written to the shared folder and read again: lineage ends there, and lost executors cost nothing."""
        at = self.path(name)
        (df.write.partitionBy(by) if by else df.write).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.at = at
        return out

    def table(self, name: str) -> str:
        """The name of a new table of the warehouse."""
        self.tables.append(f"wardline_{name}_{uuid.uuid4().hex}")
        return self.tables[-1]

    def drop(self, *done: DataFrame) -> None:
        """Delete tables of `cut` that nothing reads any more, and let go of shuffle files that no plan refers to."""
        for df in done:
            forget(self.spark, df.at)
            self.paths.remove(df.at)
        self.spark._jvm.java.lang.System.gc()

    def close(self, *kept: DataFrame) -> None:
        """Delete everything but `kept`, which belongs to whoever gets it."""
        keep = {df.at for df in kept}
        forget(self.spark, *(p for p in self.paths if p not in keep))
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.paths, self.tables = [p for p in self.paths if p in keep], []
