"""Record tables derived from the driver tables by Spark, so every query's
work grows with its inputs.

* ``event_records`` – one observation per event: panel key
  (entity = user and day), a status (500 for error events), a content hash
  of the payload, an error text for failed observations.
* ``doc_records`` – documents with their labels (left join: unlabeled
  documents have missing label fields), content hash and entity id.
* ``fetch_log`` – events seen as fetches: host per event type, so five
  hosts each hold a fifth of all rows (a skew test by construction).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.records import content_hash


def event_records(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string"), F.lit(":"),
                 F.date_format("ts", "yyyy-MM-dd")).alias("entity_id"),
        "event_id", "user_id", F.col("ts").alias("observed_at"), "event_type",
        F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200)).alias("status_code"),
        content_hash("props").alias("content_hash"),
        F.when(F.col("event_type") == "error", F.lit("server error")).alias("error"),
        "value",
    )


def doc_records(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    return docs.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("entity_id"),
        "doc_id", "text", "lang", "source", "n_chars", "quality", "toxic",
        content_hash("text").alias("content_hash"),
    )


def fetch_log(events: DataFrame) -> DataFrame:
    host = F.concat(F.col("event_type"), F.lit(".example.com"))
    return events.select(
        "event_id", host.alias("host"),
        F.concat(F.lit("https://"), host, F.lit("/e/"), F.col("event_id").cast("string")).alias("source_url"),
        F.col("ts").alias("fetched_at"),
        F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200)).alias("status_code"),
    )
