"""End-to-end flows of the three lifecycles, each over many inputs (survey
section 3). With CSS fields the parsed node table is written once; the rest is lazy.

* ``extract_records``    – archived responses -> decoded -> default title/text
  or CSS fields -> merged with their metadata (FN-2, EXT-1/2/3, PRJ-5)
* ``url_list_dataset``   – URL list -> records or failure rows (SRC-2, JN-1)
* ``listing_dataset``    – listings -> links -> detail records with lineage
  (EXT-4, FLT-1, JN-2)
* ``quality_report``     – the audit tables of one dataset (AGG-1/2/6/8)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.charset import decode_body
from strata.functions.records import archive_row_id, content_hash
from strata.operators import columns as C
from strata.operators import html as H
from strata.operators import joins as J
from strata.operators import links as LK
from strata.operators import quality as Q
from strata.session import materialize
from strata.sources.files import read_url_list

ROW_ID = "__row_id"


def extract_records(archive: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Archive rows (``body``, ``headers`` and metadata) -> one record per row:
    metadata plus ``title``/``text`` (no fields given) or one column per field
    (value = the single match, else a JSON list), and ``extraction_errors``
    (bad selectors, empty body). The body is decoded next to the bytes and
    dropped. n archive rows give n records whatever their paths: extractions
    are keyed by ``archive_row_id``, a digest of the whole row, which is never
    null. ``record_id`` is that digest and the row's number among equal rows."""
    ident = archive_row_id(archive.columns)
    pages = archive.select(ident.alias("page_id"), decode_body("body", "headers").alias("html"))
    meta = number_copies(archive.select(ident.alias(ROW_ID), "*").withColumn("__body_len", F.length("body")).drop("body"))
    if not fields:
        ex = H.extract_title_text(pages).withColumnRenamed("page_id", ROW_ID) \
              .withColumn("extraction_errors", F.lit(None).cast("array<string>"))
    else:
        # rows of one id hold one body: its nodes count once
        nodes = materialize(H.shred_elements(pages, path_attrs=H.selector_attrs(*fields.values()))
                            .dropDuplicates(["page_id", "node_id"]), "nodes")
        vals = H.field_records(H.select_fields(nodes, fields, pages))
        # one pivot pass: each field's value and error side by side
        wide = vals.groupBy("page_id").pivot("field", list(fields)).agg(
            F.first("value").alias("v"), F.first("error").alias("e"))
        errs = F.filter(F.array(*[F.col(f"`{f}_e`") for f in fields]), lambda x: x.isNotNull())
        ex = wide.select(F.col("page_id").alias(ROW_ID), *[F.col(f"`{f}_v`").alias(f) for f in fields],
                         errs.alias("extraction_errors"))
    return C.merge_extracted(meta, ex, ROW_ID, body_len="__body_len").drop("__body_len", ROW_ID)


def number_copies(meta: DataFrame) -> DataFrame:
    """``meta``, written once, with ``record_id``: ``ROW_ID`` and the row's
    number, from 0, among the rows of that id. Rows are ranked in parts (the
    tasks that wrote them) and a part goes on where the ones before it end, so
    that an id with very many equal rows spans many tasks."""
    part = [ROW_ID, "__part"]
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("__body_len"))
    held = materialize(meta.withColumn("__part", F.spark_partition_id()).withColumn("__rank", rank), "archive-rows")
    sizes = held.groupBy(*part).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(ROW_ID).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.sum("__n").over(before)).where("__start > 0").drop("__n")
    number = F.coalesce("__start", F.lit(0)) + F.col("__rank") - 1
    return held.join(starts, part, "left").withColumn("record_id", F.concat_ws("-", ROW_ID, number)) \
        .drop("__part", "__rank", "__start")


def url_list_dataset(spark: SparkSession, url_csv: str, records: DataFrame, url_column: str = "url",
                     limit: int | None = None) -> DataFrame:
    """Requested URLs -> their records, or failure rows after the records."""
    urls = read_url_list(spark, url_csv, url_column, limit)
    return J.batch_extract(urls.select("seq", "url"), records)


def listing_dataset(listings: DataFrame, records: DataFrame, html: str = "html", base: str = "final_url",
                    listing_url: str = "source_url", max_links: int | None = None,
                    allow: str | None = None, deny: str | None = None) -> DataFrame:
    """Listing pages -> discovered detail links (first-seen, capped, then
    allow/deny) -> detail records with ``listing_url`` and
    ``listing_content_hash``, or failure rows carrying ``listing_url``."""
    lp = listings.select(F.col(listing_url).alias("listing_url"), F.col(base).alias("__base"), F.col(html).alias("__html"),
                         content_hash(F.col(html)).alias("listing_content_hash"))
    links = LK.discover_links(lp, html="__html", base="__base", keys=("listing_url", "listing_content_hash"),
                              max_links=max_links, allow=allow, deny=deny)
    return J.listing_details(links, records)


def quality_report(df: DataFrame) -> dict[str, DataFrame]:
    """The audit of one dataset as small DataFrames (no driver collection)."""
    summary = Q.record_summary(df)
    return {"summary": summary, "status": Q.status_distribution(df), "missing": Q.missing_values(df),
            "notes": Q.quality_notes(summary)}
