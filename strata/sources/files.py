"""Record files, URL lists and existing tables (SRC-1, SRC-2, SRC-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CSV = {"header": True, "multiLine": True, "escape": '"', "inferSchema": False, "encoding": "UTF-8"}


def read_records(spark: SparkSession, path: str, schema=None, multiline: bool = True) -> DataFrame:
    """SRC-1: JSON Lines (blank lines skipped) or CSV (every value a string,
    a UTF-8 BOM tolerated, quoted commas / quotes / newlines kept). Any
    other suffix is an error. A CSV file with line breaks inside quotes is one
    task; ``multiline=False`` states that there are none, so that it is split."""
    low = path.lower().rstrip("/")
    if low.endswith(".jsonl"):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    if low.endswith(".csv"):
        return spark.read.options(**{**_CSV, "multiLine": multiline}).csv(path)
    raise ValueError(f"Unsupported input format: {path}")


def read_url_list(spark: SparkSession, path: str, url_column: str = "url",
                  limit: int | None = None) -> DataFrame:
    """SRC-2: URL column trimmed, blanks dropped, duplicates kept; the first
    ``limit`` URLs in file order (``None`` or 0 = all). A missing column is
    an error (checked on the header only).

    Order is data: ``(source_file, seq)`` where ``seq`` comes from
    ``monotonically_increasing_id`` on the multi-line CSV scan, which reads
    each file as one split, so ``seq`` follows the file text. The limit is a
    distributed top-k on that key, not a global window.
    """
    raw = spark.read.options(**_CSV).csv(path)
    if url_column not in raw.columns:
        raise ValueError(f"URL column '{url_column}' not found in {path}")
    urls = (raw.select(F.input_file_name().alias("source_file"),
                       F.monotonically_increasing_id().alias("seq"),
                       F.regexp_replace(F.col(f"`{url_column}`"), r"(?U)^\s+|\s+$", "").alias("url"))
            .filter(F.col("url").isNotNull() & (F.col("url") != "")))
    return urls.orderBy("source_file", "seq").limit(limit) if limit else urls


def read_structured(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    """SRC-4: an existing CSV / JSONL / Parquet table as a source."""
    fmt = fmt.lower()
    if fmt == "csv":
        return spark.read.options(**{**_CSV, **options}).csv(path)
    if fmt in ("jsonl", "json"):
        return spark.read.options(**options).json(path)
    if fmt == "parquet":
        return spark.read.options(**options).parquet(path)
    raise ValueError(f"Unsupported format: {fmt}")
