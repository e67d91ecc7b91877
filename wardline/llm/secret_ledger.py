"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by SHA-256. The ledger, in the shared folder, holds for
each blob and rule version the findings of its one scan. `scan` looks at blobs that the ledger lacks under
the present rule version only, adds their findings, and joins findings back to all paths: a copy, a moved
file or an old version costs a hash, and a new rule version scans each blob once more.

Copies are merged by a map-side aggregate before the shuffle, so a hot blob sends one row per task. The join
back moves digests and spans, not texts; Spark splits its hot partitions.

A scan that is lost half way leaves no entry: a part of the ledger counts once its writer committed it, and
an entry written twice (two scans at once) is merged when read.

Defined results: null text is the empty text; a path's every row is a version and gets a row; null ids stay;
very long texts are scanned whole, one at a time; an empty table gives an empty result. `scan` returns id,
blob and findings; other columns aren't carried, so their names can't clash. `redact` keeps all columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import nested, unnested
from wardline.sources.scratch import Store, forget, scratch

#: The kinds in their order in a list of spans; those after `hex` are added to the base.
KINDS = ("assign", "access", "hex", "pem", "github", "jwt")
RULE_VERSION = "base-1+added-1"
FINDINGS = "array<struct<kind:string,start:bigint,end:bigint>>"


def rules() -> dict[str, tuple[re.Pattern[str], int, int]]:
    """kind -> pattern, the group whose length counts, and its least length."""
    return {
        "assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 1, 6),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
        "pem": (re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), 0, 1),
        "github": (re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 1),
        "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 1),
    }


def find(text: str, patterns: dict[str, tuple[re.Pattern[str], int, int]]) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all spans in code points, in order; leftmost, not overlapping within a kind."""
    found = []
    for k, (pattern, group, least) in enumerate(patterns.values()):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    patterns = rules()
    kinds = list(patterns)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in find(x or "", patterns)] for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(spans, span)], ["blob", "findings"])


class Ledger:
    """A ledger at a path of the shared folder; a new one where none is given."""

    def __init__(self, spark: SparkSession, path: str | None = None, rule_version: str = RULE_VERSION):
        self.spark, self.path, self.rule_version = spark, path or scratch(spark, "ledger"), rule_version
        self.schema = f"blob string, rule_version string, findings {FINDINGS}"

    def _there(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def entries(self) -> DataFrame:
        """blob, findings under this rule version, each blob once."""
        if not self._there():
            return self.spark.createDataFrame([], f"blob string, findings {FINDINGS}")
        rows = self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("rule_version") == self.rule_version)
        return rows.groupBy("blob").agg(F.first("findings").alias("findings"))

    def add(self, versions: DataFrame, text: str = "text") -> None:
        """Scan the blobs of versions that have no entry yet, and enter them."""
        t = F.coalesce(F.col(text), F.lit(""))
        blobs = versions.select(F.sha2(t, 256).alias("blob"), t.alias("text"))
        if self._there():
            blobs = blobs.join(self.entries().select("blob"), "blob", "left_anti")
        blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        found = blobs.mapInArrow(_scan, f"blob string, findings {FINDINGS}")
        found.select("blob", F.lit(self.rule_version).alias("rule_version"), "findings").write.mode("append").parquet(self.path)

    def scan(self, versions: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
        """id, blob, findings: a row for each row of versions, with every finding of its blob."""
        self.add(versions, text)
        paths = versions.select(F.col(id_).alias(id_), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))
        # Only blobs with findings are needed; the rest of the paths have none.
        hits = self.entries().filter(F.size("findings") > 0)
        none = F.array().cast(FINDINGS)
        return paths.join(hits, "blob", "left").select(id_, "blob", F.coalesce("findings", none).alias("findings"))

    def drop(self) -> None:
        forget(self.spark, self.path)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: Ledger, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of the ledger's findings replaced by mark; overlapping spans are merged. Columns stay."""
    ledger.add(docs, text)
    hits = ledger.entries().filter(F.size("findings") > 0)
    t = F.col("row").getField(text)
    marked = nested(docs, blob=F.sha2(F.coalesce(t, F.lit("")), 256)).join(hits, "blob", "left")
    # Spans in order; each starts where no earlier one reaches.
    spans = F.transform("findings", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["a"] >= acc["at"]
        kept = F.substring(t, (acc["at"] + 1).cast("int"), F.greatest(s["a"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.when(fresh, F.concat(acc["out"], F.array(kept, F.lit(mark)))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["b"]).alias("at"),
        )

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(t, (acc["at"] + 1).cast("int"), F.length(t)))

    clean = F.when(F.col("findings").isNull(), t).otherwise(F.aggregate(spans, zero, step, end))
    return unnested(marked, docs.columns, **{text: clean})


def secrets(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans. Without a ledger a new one is used, and dropped."""
    store = Store(docs.sparkSession)
    own = ledger or Ledger(docs.sparkSession)
    rows = own.scan(docs)
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda s: s["kind"].isin("assign", "access", "hex"))
    out = rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
    if ledger is None:
        out = store.cut(out, "secrets")
        own.drop()
    return out
