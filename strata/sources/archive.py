"""Archived responses as a table (SRC-3) and archives derived from pages."""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.records import archive_stem, content_hash, guess_extension
from strata.schemas import ARCHIVE

ARCHIVE_EPOCH = "2024-01-01 00:00:00"


def archive_from_pages(pages: DataFrame, fetcher: str = "archive", spacing_seconds: int = 10) -> DataFrame:
    """Turn a ``pages(page_id, url, html)`` table into archive rows.

    Body bytes are the UTF-8 encoding of the page, status 200, a text/html
    content type; ``fetched_at`` is derived from the page id (one fetch per
    ``spacing_seconds``) so every derived value is deterministic.
    """
    body = F.encode(F.col("html"), "UTF-8")
    return pages.select(
        F.col("page_id"),
        F.col("url").alias("source_url"),
        F.col("url").alias("final_url"),
        F.lit(200).alias("status_code"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8")).alias("headers"),
        body.alias("body"),
        (F.lit(ARCHIVE_EPOCH).cast("timestamp") + F.make_interval(secs=F.col("page_id") * spacing_seconds)).alias("fetched_at"),
        F.lit(fetcher).alias("fetcher_name"),
    ).withColumn("content_hash", content_hash("body"))


def with_archive_paths(archive: DataFrame, root: str) -> DataFrame:
    """Add ``raw_file_path`` as '<root>/<stem><ext>' (FN-9, FN-3)."""
    return archive.withColumn(
        "raw_file_path",
        F.concat(F.lit(root.rstrip("/") + "/"), archive_stem("fetched_at", "content_hash"),
                 guess_extension("headers")))


def read_archive(spark: SparkSession, raw_path: str, meta_path: str) -> DataFrame:
    """SRC-3: raw bodies plus sidecar JSON metadata with the same file stem.

    Bodies come from the ``binaryFile`` source, sidecars from the JSON reader;
    they are joined on the stem, so both sides shuffle on one short key and
    the body bytes travel once.
    """
    raw = (spark.read.format("binaryFile").load(raw_path)
           .select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"),
                   F.col("path").alias("raw_file_path"), F.col("content").alias("body")))
    meta_schema = ARCHIVE_META_SCHEMA
    meta = (spark.read.schema(meta_schema).option("multiLine", True).json(meta_path)
            .withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1))
            .drop("raw_file_path"))
    return meta.join(raw, "stem", "inner").withColumn(
        "fetched_at", F.col("fetched_at").cast("timestamp"))


ARCHIVE_META_SCHEMA = (
    "source_url string, final_url string, fetched_at string, status_code int, content_hash string, "
    "raw_file_path string, headers map<string,string>, extractor_name string, extractor_version string")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):  # Spark writes file:/x as well as file:///x, and escapes what a URI cannot hold
        return fs.LocalFileSystem(), "/" + unquote(path[len("file:"):]).lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_archive_files(archive: DataFrame, raw_path: str, meta_path: str, stem: str = "stem") -> None:
    """The two-file layout: ``<raw_path>/<stem><ext>`` with the body and
    ``<meta_path>/<stem>.json`` with the metadata of each row. A null body or
    null ``meta`` (a JSON text) leaves its file out. Written by the tasks that
    hold the rows; a task that runs again writes the same files again."""
    def write(batches):
        places = {}
        for root in (raw_path, meta_path):
            places[root] = _open(root)
            places[root][0].create_dir(places[root][1], recursive=True)
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                for root, name, data in ((raw_path, r["stem"] + r["ext"], r["body"]), (meta_path, r["stem"] + ".json", r["meta"])):
                    if data is not None:
                        store, folder = places[root]
                        with store.open_output_stream(f"{folder}/{name}") as out:
                            out.write(data.encode() if isinstance(data, str) else data)
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    archive.select(F.col(stem).alias("stem"), guess_extension("headers").alias("ext"), "body", "meta") \
        .mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


#: Bodies a batch of rows is read with, in bytes; one larger body is a batch of its own.
BODY_BATCH = 32 << 20


def read_archive_files(spark: SparkSession, raw_path: str, meta_path: str) -> DataFrame:
    """SRC-3 with what a crawl that broke off leaves: a row per stem that has
    a body or a sidecar, with ``archive_status``:

    * ``ok``: both files, and the body has the recorded hash (or none is recorded)
    * ``partial``: both files, but the body is not the recorded one, or the
      sidecar is no JSON document
    * ``no_body`` / ``no_sidecar``: the other file alone.

    Only names and sidecars meet in the join. A body is opened by the task that
    holds its row afterwards and crosses no shuffle; two raw files of one stem
    give two rows. Spark's listing leaves empty files out, so a sidecar without
    a listed body looks for the file its headers name; an empty body without
    sidecar is not seen.
    """
    stem = lambda path: F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    names: Column = F.col("path")
    raw = spark.read.format("binaryFile").load(raw_path).select(stem(names).alias("stem"), names.alias("raw_file_path"))
    texts = spark.read.option("wholetext", True).text(meta_path).select(
        F.regexp_replace(stem(F.input_file_name()), "%20", " ").alias("stem"),
        F.from_json("value", ARCHIVE_META_SCHEMA, {"mode": "PERMISSIVE"}).alias("m"))
    meta = texts.select("stem", F.col("m").isNotNull().alias("__sidecar"), "m.*").drop("raw_file_path")
    both = meta.join(raw, "stem", "full").withColumn(
        "__expected", F.concat(F.lit(raw_path.rstrip("/") + "/"), "stem", guess_extension("headers")))
    kept = [f"`{c}`" for c in both.columns]

    def read(batches):
        for batch in batches:
            listed, likely = (batch.column(c).to_pylist() for c in ("raw_file_path", "__expected"))
            paths, bodies, start, held = [], [], 0, 0
            for i, path in enumerate(listed):
                path, body = path or likely[i], None
                store, name = _open(path)
                if listed[i] is not None or store.get_file_info(name).type == fs.FileType.File:
                    with store.open_input_stream(name) as f:
                        body = f.read()
                paths.append(None if body is None else path)
                bodies.append(body)
                held += len(body or b"")
                if held >= BODY_BATCH or i + 1 == len(listed):
                    some = batch.slice(start, len(bodies))
                    some = some.set_column(some.schema.get_field_index("raw_file_path"), "raw_file_path", pa.array(paths, pa.string()))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(bodies, pa.binary())], names=[*some.schema.names, "body"])
                    paths, bodies, start, held = [], [], i + 1, 0

    schema = both.select(*kept, F.lit(None).cast("binary").alias("body")).schema
    found = both.mapInArrow(read, schema)
    same = F.col("content_hash").isNull() | (F.col("content_hash") == content_hash("body"))
    known = F.coalesce(F.col("source_url"), F.col("final_url"), F.col("content_hash"), F.col("fetched_at"))
    status = (F.when(F.col("raw_file_path").isNull(), "no_body").when(F.col("__sidecar").isNull(), "no_sidecar")
              .when(F.col("__sidecar") & known.isNotNull() & same, "ok").otherwise("partial"))
    return found.withColumn("archive_status", status).drop("__sidecar", "__expected") \
        .withColumn("fetched_at", F.try_to_timestamp("fetched_at"))


__all__ = ["ARCHIVE", "archive_from_pages", "read_archive", "read_archive_files", "with_archive_paths", "write_archive_files"]
