"""Content-addressed WARC archive.

`write` splits records in two. `payloads`, a table of the warehouse in buckets of the digest, holds each payload's
bytes once, under its SHA-256; its SHA-1, the digest that WARC headers carry, is recomputed from the stored bytes when they are
read. `records`, in the shared folder, holds each record's exact header blocks (WARC and HTTP) and its payload's digest. `read` joins
them back to the original records, checks both digests, and `report` parses the records' bytes.

Of records with equal payloads of `least` bytes or more, the one with the largest id is a response and the
others revisits that refer to it, whose block in the WARC stream ends with the HTTP head; smaller ones are all
responses.

Payload copies are merged map-side before their one shuffle; the join back goes bucket to bucket without moving
them. Records of a payload that more than `HOT` share would be one task's: those payloads, few as each stands for
many records, are moved in a join whose hot partitions Spark splits. The rows are the same either way. Both tables are written through Spark's committer, so a lost
executor costs a task.

Defined results: a null payload is empty; null urls give an empty target; rows that share the largest id (and
url) of a payload are all responses; null ids come last among a payload's; rows equal in id, url and payload
are one record id; very long payloads are one record; an empty table gives empty tables; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources.scratch import Store

#: Records of a payload that are joined within its bucket.
HOT = 64
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: Column, url: Column, sha256: Column) -> Column:
    said = F.concat_ws("\n", F.lit("wardline-record"), F.coalesce(page.cast("string"), F.lit("null")), F.coalesce(url, F.lit("")), sha256)
    h = F.sha1(said.cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def http_head() -> Column:
    size = F.col("payload_bytes").cast("string")
    return F.concat(F.lit("HTTP/1.1 200 OK" + CRLF), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", size), F.lit(CRLF))


def headers(date: str) -> Column:
    """The header block of a record, up to the blank line that ends it."""
    revisit = F.col("record_type") == "revisit"
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "%0A")
    block = F.octet_length("head") + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("sha256"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", record_id(F.col("first.page_id"), F.col("first.url"), F.col("sha256"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit(CRLF),
    )


class Archive:
    """An archive: a table of payloads in the warehouse, and a folder of records in the shared one."""

    def __init__(self, spark: SparkSession):
        self.store = Store(spark)

    def write(self, pages: DataFrame, least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> Archive:
        body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
        rows = pages.select("page_id", "url", body.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
        spark, self.payloads = self.store.spark, self.store.table("payloads")
        buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        store = rows.groupBy("sha256").agg(F.first("payload").alias("payload"), F.count("*").alias("copies"))
        store.write.bucketBy(buckets, "sha256").sortBy("sha256").format("parquet").saveAsTable(self.payloads)
        self.store.drop()
        heads = rows.select("page_id", "url", "sha256", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
        # The last record of each large payload: an aggregate with map-side combine, joined back.
        first = heads.groupBy("sha256").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies"))
        heads = heads.join(first, "sha256")
        revisit = (F.col("payload_bytes") >= least) & (F.col("copies") > 1)
        revisit &= ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
        heads = heads.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("head", http_head())
        self.records = self.store.cut(heads.select("page_id", "sha256", "copies", "record_type", headers(date).alias("headers"), "head"), "warc-records")
        return self

    def read(self) -> DataFrame:
        """page_id, headers, payload (whole, also of revisits), record (the WARC bytes): the records as they were written, both digests checked."""
        spark = self.store.spark
        where = spark.sql(f"DESCRIBE TABLE EXTENDED {self.payloads}").filter("col_name = 'Location'").first()["data_type"]
        few, many = F.col("copies") <= HOT, F.col("copies") > HOT
        both = self.records.filter(few).join(spark.table(self.payloads).filter(few).select("sha256", "payload").hint("merge"), "sha256")
        both = both.unionByName(self.records.filter(many).join(spark.read.schema(spark.table(self.payloads).schema).parquet(where).filter(many).select("sha256", "payload"), "sha256"))
        said = F.regexp_extract("headers", "WARC-Payload-Digest: sha1:([0-9a-f]+)", 1)
        sound = (F.sha2("payload", 256) == F.col("sha256")) & (F.sha1("payload") == said)
        payload = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary"))
        block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
        record = F.concat(F.col("headers").cast("binary"), F.col("head").cast("binary"), block, F.lit(CRLF * 2).cast("binary"))
        return both.select("page_id", "headers", payload.alias("payload"), record.alias("record"))

    def drop(self) -> None:
        self.store.close()


def parsed(record: Column) -> Column:
    """struct<head, http, payload> of a record's bytes: both header blocks without the blank line, and what follows them."""
    text = F.decode(record, "UTF-8")
    head = F.substring_index(text, CRLF * 2, 1)
    size = F.regexp_extract(head, "\\r\\nContent-Length: ([0-9]+)", 1).cast("int")
    begin = F.octet_length(head) + 5
    block = F.substring(record, begin, size)
    http = F.substring_index(F.decode(block, "UTF-8"), CRLF * 2, 1)
    return F.struct(head.alias("head"), http.alias("http"), F.substring(block, F.octet_length(http) + 5, size).alias("payload"))


def report(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to out of the bytes of records that were read back.

    A response's payload is what its bytes hold; a revisit's length is what its HTTP head says, and it names its
    response by record id. A response whose payload hasn't the digest that its header says fails.
    """
    field = lambda name: F.regexp_extract("r.head", f"\\r\\n{name}: ([^\\r]*)", 1)
    rows = records.select("page_id", parsed(F.col("record")).alias("r"))
    digest = F.substring_index(field("WARC-Payload-Digest"), ":", -1)
    revisit = field("WARC-Type") == "revisit"
    size = F.regexp_extract("r.http", "\\r\\nContent-Length: ([0-9]+)", 1).cast("long")
    sound = revisit | ((F.sha1("r.payload") == digest) & (F.octet_length("r.payload") == size))
    checked = F.when(sound, digest).otherwise(F.raise_error(F.concat(F.lit("damaged record "), field("WARC-Record-ID"))))
    rows = rows.select("page_id", size.alias("payload_bytes"), checked.alias("payload_digest"), field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("id"), field("WARC-Refers-To").alias("to"))
    return rows


def archived(pages: DataFrame) -> DataFrame:
    """Write pages, read them back and report. The result reads a small table of the shared folder."""
    archive = Archive(pages.sparkSession).write(pages)
    rows = archive.store.cut(report(archive.read()), "warc-report")
    known = rows.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "id").distinct()
    rest, revisits = rows.filter("to = ''"), rows.filter("to <> ''")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    found = revisits.drop("id").join(known, F.col("to") == F.col("id")).select(*columns)
    out = archive.store.cut(rest.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(found), "warc-pages")
    archive.store.close(out)
    return out
