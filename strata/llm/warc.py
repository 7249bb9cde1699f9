"""A content-addressed web archive.

Payload bytes are stored once, under their SHA-256, in one table; the exact
header block of every WARC record is kept in another. Records come back by
joining headers to payloads, and a payload whose bytes no longer have the
digest they are filed under is an error, not a record. Of the records with
equal payloads of at least ``min_bytes`` bytes the one with the largest
``page_id`` is the response; the others are revisits that refer to it.

Edge cases: a null ``html`` is an empty payload; a null ``url`` leaves out the
target line, and line breaks in one are percent-encoded; a null ``page_id`` is
smaller than any other and its record has the id ``null``; repeated rows are
records of their own (several may be the response); an empty table gives an
empty archive; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.skew import split_join

#: Fixed value: the alphabet of RFC 4648 base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_LEAST = -(1 << 63)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1: five bytes make eight letters."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _DIGITS, BASE32)


def _pages(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload")) \
        .withColumn("key", F.coalesce("page_id", F.lit(_LEAST))).withColumn("strong", F.sha2("payload", 256))


def _header(kind: Column, date: str) -> Column:
    safe = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value)
    return F.concat(F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), line("WARC-Type", kind), line("WARC-Record-ID", urn(F.col("page_id"))),
        F.lit("WARC-Date: " + date), line("WARC-Target-URI", safe),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(kind == "revisit", line("WARC-Refers-To", urn(F.col("response_id")))),
        F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(F.col("size").cast("string")))),
        F.lit("\r\n\r\n"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes ``path/headers`` and ``path/payloads``."""
    rows = _pages(pages)
    facts = rows.select("page_id", "key", "url", "strong", F.octet_length("payload").cast("long").alias("size"),
                        base32_sha1(F.col("payload")).alias("sha1"))
    facts.write.option("compression", "zstd").parquet(f"{path}/facts")  # without bytes: what the joins below move
    facts = pages.sparkSession.read.parquet(f"{path}/facts")
    newest = facts.groupBy("strong").agg(F.max("key").alias("newest"))
    joined = split_join(facts, newest, "strong")
    response_id = F.when(F.col("newest") > _LEAST, F.col("newest"))
    kind = F.when((F.col("size") >= min_bytes) & (F.col("key") < F.col("newest")), "revisit").otherwise("response")
    joined.withColumn("response_id", response_id).select("strong", _header(kind, date).alias("header")) \
        .write.option("compression", "zstd").parquet(f"{path}/headers")
    # equal digests meet in each map task first, so a payload of many pages moves once a task
    rows.select("strong", "payload").dropDuplicates(["strong"]) \
        .write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    headers = spark.read.schema("strong string, header string").parquet(f"{path}/headers")
    payloads = spark.read.schema(T.StructType().add("strong", "string").add("payload", "binary")).parquet(f"{path}/payloads")
    ok = F.sha2("payload", 256) == F.col("strong")
    checked = F.when(ok, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is not "), F.col("strong"))))
    return headers, payloads.select("strong", checked.alias("payload"))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: its header fields, and size and digest computed
    from the stored payload (once a payload, however many records share it)."""
    headers, payloads = _tables(spark, path)
    facts = payloads.select("strong", F.octet_length("payload").cast("long").alias("payload_bytes"),
                            base32_sha1(F.col("payload")).alias("payload_digest"))
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    fields = headers.select("strong", number(_field("WARC-Record-ID")).alias("page_id"), _field("WARC-Type").alias("record_type"),
                            number(F.coalesce(_field("WARC-Refers-To"), F.lit(""))).alias("refers_to"),
                            _field("WARC-Target-URI").alias("url"),
                            F.regexp_extract("header", "WARC-Payload-Digest: sha1:([A-Z2-7]*)", 1).alias("told"))
    same = F.when(F.col("told") == F.col("payload_digest"), F.col("payload_digest")) \
        .otherwise(F.raise_error(F.lit("a header names another payload")))
    return fields.join(facts, "strong").select("page_id", "url", "payload_bytes", same.alias("payload_digest"),
                                               "record_type", "refers_to")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(header, record)``: the original records, byte for byte; a revisit has
    no body."""
    headers, payloads = _tables(spark, path)
    body = headers.where(_field("WARC-Type") == "response").join(payloads, "strong").select("header", "payload")
    bare = headers.where(_field("WARC-Type") == "revisit").select("header", F.lit(None).cast("binary").alias("payload"))
    end = F.lit("\r\n\r\n").cast("binary")
    return body.unionByName(bare).select("header", F.concat(
        F.encode("header", "UTF-8"), F.coalesce("payload", F.lit("").cast("binary")), end).alias("record"))
