"""Readers and writers of the files that a corpus comes and goes in."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import wardline.sources.scratch  # noqa: F401  (functions travel whole)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, infer: bool = False, comment: str | None = None, ragged: str | None = None) -> DataFrame:
    """A CSV with a header: quoted commas and line ends, doubled quotes, a byte order mark dropped. All text without schema or infer; comments skipped and cells trimmed if asked; ragged names the column that gets rows with too few or too many cells."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("nullValue", "").option("encoding", "UTF-8")
    reader = reader.option("inferSchema", infer).option("mode", "PERMISSIVE")
    if comment:
        reader = reader.option("comment", comment).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if ragged:
        reader = reader.option("columnNameOfCorruptRecord", ragged)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    clean = [c.removeprefix("﻿") for c in df.columns]
    return df.toDF(*clean)


def resolutions(spark: SparkSession, path: str, decision: str = "decision") -> DataFrame:
    """An override file: rows with a blank decision decide nothing."""
    df = read_csv(spark, path, comment="#")
    return df.filter(F.trim(F.coalesce(F.col(decision), F.lit(""))) != "")


def register_all(spark: SparkSession, folder: str) -> list[str]:
    """Every parquet table of a folder as a view, in Pascal case: mo_signatures.parquet is MoSignatures."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = []
    for status in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at):
        file = status.getPath().getName()
        if file.endswith(".parquet"):
            name = "".join(part.capitalize() for part in file[:-8].split("_"))
            spark.read.parquet(f"{folder}/{file}").createOrReplaceTempView(name)
            names.append(name)
    return sorted(names)


def read_ndjson(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def wanted(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The first row of each wanted key (keys: one column of that name); a key without a row is an error when the result is read."""
    found = rows.join(keys, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.to_json(F.struct(*rows.columns))).alias("row"))
    both = keys.distinct().join(found, key, "left")
    checked = F.when(F.col("row").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string")))).otherwise(F.col(key))
    return both.withColumn(key, checked).select(*[F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in rows.columns])


def read_features(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The features of GeoJSON documents, a row each; schema: of one feature."""
    inner = schema if isinstance(schema, str) else schema.simpleString()
    return spark.read.schema(f"features array<struct<{inner}>>" if isinstance(schema, str) else f"features array<{inner}>").option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """name, lat, lon of a KML file's points, at the placemark itself or nested in a MultiGeometry; those without finite coordinates go."""
    schema = "ExtendedData struct<SchemaData: struct<SimpleData: array<struct<_VALUE: string, _name: string>>>>, Point struct<coordinates: string>, MultiGeometry struct<Point: struct<coordinates: string>>, name string"
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    at = F.split(F.trim(F.coalesce("Point.coordinates", "MultiGeometry.Point.coordinates")), ",")
    rows = rows.select(F.coalesce(F.try_element_at(F.filter("ExtendedData.SchemaData.SimpleData", lambda d: d["_name"] == "POL_STAName"), F.lit(1))["_VALUE"], F.col("name")).alias("name"), F.try_element_at(at, F.lit(2)).try_cast("double").alias("lat"), F.try_element_at(at, F.lit(1)).try_cast("double").alias("lon"))
    return rows.filter("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")


def document(rows: DataFrame, key: str, value: Any) -> dict[str, Any] | None:
    """One document by key, or none."""
    found = rows.filter(F.col(key) == value).limit(1).collect()
    return found[0].asDict(recursive=True) if found else None


def read_array(spark: SparkSession, path: str, dtype: str, length: int | None = None) -> DataFrame:
    """path, place, value of files of one numeric type; a wrong length is an error."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                values = np.frombuffer(content, dtype)
                if length is not None and len(values) != length:
                    raise ValueError(f"{name} has {len(values)} values")
                yield pd.DataFrame({"path": name, "place": np.arange(len(values)), "value": values.astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, place long, value double")


def cell_text(c: Column) -> Column:
    """A value as a CSV cell: quoted if it holds a quote, comma or line end, quotes doubled, null empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_typed(df: DataFrame, path: str, types: dict[str, str], codec: str = "zstd") -> int:
    """Declared columns, cast to their types, as parquet; the number of rows. An empty text is null, as in staged files."""
    cast = [(F.nullif(F.col(c), F.lit("")) if df.schema[c].dataType.simpleString() == "string" else F.col(c)).cast(t).alias(c) for c, t in types.items()]
    df.select(*cast).write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.parquet(path).count()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def put_document(folder: str, key: str, value: dict[str, Any]) -> str:
    """One JSON document, put in place whole: written beside and renamed."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{key}.json"
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "w", encoding="utf-8") as f:
        json.dump({**value, "id": key}, f, ensure_ascii=False, sort_keys=True)
    os.replace(beside, path)
    return path


class Cache:
    """Values with an end, one document each."""

    def __init__(self, folder: str, now: Any = time.time):
        self.folder, self.now = folder, now

    def put(self, key: str, value: Any, seconds: float) -> None:
        put_document(self.folder, hashlib.sha256(key.encode()).hexdigest(), {"expires_at": self.now() + seconds, "value": value})

    def get(self, key: str) -> Any:
        path = f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()}.json"
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        return held["value"] if held["expires_at"] > self.now() else None


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in by key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of new that old hasn't, as they are: a load that skips equal documents."""
    digest = lambda df: F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    return new.withColumn("_digest", digest(new)).join(old.select(digest(old).alias("_digest")).distinct(), "_digest", "left_anti").drop("_digest")


def warm(counts: DataFrame, stations: int = 20, heads: int = 10) -> DataFrame:
    """key, value of what a cache starts with: the largest stations (station, head, n) and the heads of each, as JSON."""
    from wardline.operators.relational import top_per_group

    totals = counts.groupBy("station").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "station").limit(stations)
    top = top_per_group(counts.join(F.broadcast(totals.select("station")), "station"), ["station"], [F.col("n").desc(), F.col("head")], heads)  # 20 rows
    by = top.groupBy("station").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "head", "n"))), lambda x: F.struct(x["head"].alias("head"), x["n"].alias("n")))).alias("value"))
    return by.select(F.concat(F.lit("station:"), "station").alias("key"), "value")


def pieces(value: Column, size: int = 12000) -> Column:
    """array<struct<part, said>>: a long text in pieces that a cache takes."""
    n = F.ceil(F.length(value) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.struct(k.alias("part"), F.substring(value, k * size + 1, F.lit(size)).alias("said")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of each file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def report(title: str, rows: DataFrame, most: int = 50) -> str:
    """A table in Markdown, of so many rows at most."""
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(most).collect()]
    return "\n".join(lines) + "\n"
