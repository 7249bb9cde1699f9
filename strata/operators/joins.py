"""Relations between requests, archives, listings, panels and rules (JN-*).

Archives are projected to metadata (and already-extracted fields) before
any join. Dimension-like sides (rules,
canonical names) are broadcast only behind a row-count bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions._util import qcol
from strata.functions.records import content_hash
from strata.functions.urls import url_host
from strata.operators.windows import latest_attempt
from strata.plans.sizing import bounded_broadcast

NO_ARCHIVE = "no archived response"


def batch_extract(urls: DataFrame, records: DataFrame, url: str = "url", seq: str = "seq",
                  key: str = "source_url") -> DataFrame:
    """JN-1: every requested URL ends as a record or a failure row
    ``(source_url, error)``; failures follow all records (order by
    ``row_kind`` 0/1, then ``seq``). An HTTP error status is a record, not a
    failure."""
    req = urls.select(qcol(seq).alias(seq), qcol(url).alias(key))
    return _records_or_failures(req, records, key)


def _records_or_failures(req: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """One left outer join: matched rows are records (``row_kind`` 0), the
    rest failure rows (``row_kind`` 1, ``error``). The request side is
    computed once, not once per branch of a union."""
    records = latest_attempt(records, key)  # one record a URL, whatever the archive's columns and attempts
    rec = records.withColumn("__found", F.lit(True))
    j = req.join(rec, key, "left")
    missing = F.col("__found").isNull()
    cols = [c for c in j.columns if c != "__found"]
    extra_error = "error" in records.columns
    out = j.select(*[F.col(c) for c in cols if not (extra_error and c == "error")],
                   F.when(missing, F.lit(NO_ARCHIVE)).otherwise(F.col("error") if extra_error else F.lit(None).cast("string")).alias("error"),
                   F.when(missing, F.lit(1)).otherwise(F.lit(0)).alias("row_kind"))
    return out


def listing_details(links: DataFrame, records: DataFrame, link: str = "link",
                    key: str = "source_url") -> DataFrame:
    """JN-2: each discovered link joined to its archived detail record, with
    ``listing_url`` and ``listing_content_hash``; links without an archive
    row become failure rows that also carry ``listing_url``."""
    return _records_or_failures(links.withColumnRenamed(link, key), records, key)


def seed_or_discovered(requested: DataFrame, discovered: DataFrame, key: str, seq: str,
                       max_n: int | None = None, require: bool = False) -> DataFrame:
    """JN-4: the explicit seed list wins when non-empty, else the discovered
    list; first ``max_n`` in order. The choice is a one-row aggregate.
    ``require=True`` raises when both lists are empty (a bounded check that
    reads at most one row)."""
    both = (requested.select(qcol(key), qcol(seq)).withColumn("__prio", F.lit(0))
            .unionByName(discovered.select(qcol(key), qcol(seq)).withColumn("__prio", F.lit(1))))
    best = both.agg(F.min("__prio").alias("__best"))
    chosen = both.join(F.broadcast(best), F.col("__prio") == F.col("__best")).drop("__best", "__prio")
    ordered = chosen.orderBy(seq)
    if require and not both.limit(1).count():
        raise ValueError("no seeds given and none discovered")
    return ordered.limit(max_n) if max_n else ordered


def missing_raw_files(records: DataFrame, files: DataFrame, path: str = "raw_file_path",
                      file_path: str = "path") -> DataFrame:
    """JN-5: records whose raw file is absent from the file listing."""
    present = files.select(F.col(file_path).alias(path)).distinct()
    return records.join(present, path, "left_anti")


def missing_waves(df: DataFrame, entity: str, ts: str, grain: str = "day") -> DataFrame:
    """JN-6: (entity, wave) pairs inside each entity's own first..last wave
    span that have no row. The expected grid is generated per entity from
    its (min, max) — one row per entity before the explode."""
    waves = df.select(qcol(entity).alias(entity), F.date_trunc(grain, qcol(ts)).alias("wave")).distinct()
    span = waves.groupBy(entity).agg(F.min("wave").alias("lo"), F.max("wave").alias("hi"))
    step = F.expr(f"INTERVAL 1 {grain.upper()}")
    grid = span.select(entity, F.explode(F.sequence("lo", "hi", step)).alias("wave"))
    return grid.join(waves, [entity, "wave"], "left_anti")


def unmatched_regions(df: DataFrame, region: str, dim: DataFrame, dim_col: str) -> DataFrame:
    """JN-7: rows whose region is missing or not in the canonical
    dimension (left anti join; dimension broadcast behind a size bound)."""
    d = dim.select(F.col(dim_col).alias("__region")).distinct()
    missing = df.filter(qcol(region).isNull() | (F.trim(qcol(region).cast("string")) == ""))
    present = df.filter(qcol(region).isNotNull() & (F.trim(qcol(region).cast("string")) != ""))
    unknown = present.join(bounded_broadcast(d), qcol(region) == F.col("__region"), "left_anti")
    return (missing.withColumn("reason", F.lit("missing"))
            .unionByName(unknown.withColumn("reason", F.lit("unknown"))))


def robots_allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """JN-8: per host the longest matching path prefix decides; equal
    length -> allow; a host without a matching rule is allowed.

    Rules ``(host, prefix, allow)``. The prefix test is turned into an equi
    join: each distinct URL yields its path prefixes of exactly the lengths
    that occur among its host's rules (a small, broadcast table), and those
    join the rules on (host, length, prefix). No URL is paired with every
    rule of its host; the winner per URL is one ``max_by`` aggregation."""
    r = rules.select(F.lower("host").alias("__h"), F.col("prefix").alias("__prefix"),
                     F.length("prefix").alias("__len"), F.col("allow").alias("__allow"))
    lens = bounded_broadcast(r.select("__h", "__len").distinct())
    path = F.regexp_extract(F.col("__u"), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    distinct_urls = urls.select(qcol(url).alias("__u")).distinct().select(
        "__u", url_host(F.col("__u")).alias("__h"),
        F.when(path == "", F.lit("/")).otherwise(path).alias("__path"))
    # only the URL prefixes whose length some rule of the host has
    cands = (distinct_urls.join(lens, "__h")
             .filter(F.length("__path") >= F.col("__len"))
             .select("__u", "__h", "__len", F.substring("__path", F.lit(1), F.col("__len")).alias("__prefix")))
    matches = cands.join(r, ["__h", "__len", "__prefix"])
    winner = matches.groupBy("__u").agg(
        F.max_by("__allow", F.struct(F.col("__len"), F.col("__allow"))).alias("__win"))
    return (urls.join(winner, qcol(url) == F.col("__u"), "left")
            .withColumn("allowed", F.coalesce(F.col("__win"), F.lit(True)))
            .drop("__u", "__win"))


def verify_archive(archive: DataFrame, files: DataFrame, key: str = "raw_file_path",
                   file_path: str = "path", body: str = "content") -> DataFrame:
    """JN-9: recompute sha256 of the stored bytes and compare with the
    recorded hash; report 'ok', 'altered', 'missing_file', 'unrecorded'.
    The hash is computed next to the bytes; only hashes are shuffled."""
    stored = files.select(F.col(file_path).alias(key), content_hash(F.col(body)).alias("stored_hash"))
    rec = archive.select(qcol(key), F.col("content_hash").alias("recorded_hash"))
    j = rec.join(stored, key, "full")
    status = (F.when(F.col("stored_hash").isNull(), "missing_file")
              .when(F.col("recorded_hash").isNull(), "unrecorded")
              .when(F.col("stored_hash") == F.col("recorded_hash"), "ok").otherwise("altered"))
    return j.withColumn("status", status)
