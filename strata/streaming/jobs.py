"""Structured Streaming versions of ingest and monitoring (STR-1..4).

All jobs are restartable: progress lives in the ``checkpointLocation``
(a folder under the cluster's shared checkpoint root), so a lost executor
or a restarted driver resumes without re-ingesting or double counting.
``Trigger.AvailableNow`` drains what is there and stops, which suits
scheduled runs; the same code runs continuously with a processing-time
trigger.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strata.functions._util import qcol

# The stateful runner starts before shipped files are on its path, so what
# this module defines travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_archive(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str,
                   fmt: str = "parquet", ts: str | None = None, partition_by: list[str] | None = None,
                   available_now: bool = True, glob: str | None = None,
                   max_files_per_trigger: int | None = None) -> StreamingQuery:
    """STR-1: new archive files are ingested once into ``sink``; re-running
    with the same checkpoint picks up only files not seen before. Naive
    timestamps are read as session-zone timestamps so watermarks apply."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:  # files of ``source`` matching ``glob`` (a folder holding other tables too)
        reader = reader.option("basePath", source).option("pathGlobFilter", glob)
    df = reader.load(source)
    if ts:
        df = df.withColumn(ts, qcol(ts).cast("timestamp"))
    w = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def stream_dedup(df: DataFrame, ts: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """STR-2: drop re-fetched identical responses: the first row per
    ``keys`` is kept while later copies arrive within ``delay`` of it."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_health(df: DataFrame, ts: str, status: str, width: str = "1 hour",
                  delay: str = "1 hour") -> DataFrame:
    """STR-3: counts per tumbling window and status (append mode): a window
    is emitted once the watermark passes its end; rows later than the
    watermark are dropped; the last open window is not emitted."""
    return (df.withWatermark(ts, delay)
            .groupBy(F.window(qcol(ts), width).alias("window"), qcol(status).alias("status"))
            .agg(F.count(F.lit(1)).alias("n")))


CHANGE_SCHEMA = T.StructType([
    T.StructField("entity", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("prev_hash", T.StringType()),
    T.StructField("change", T.StringType()),
])
#: A row an entity and micro-batch: where its hash differs from the one before
#: (microseconds since the epoch), the hashes there, and the one known before.
_OUT_SCHEMA = T.StructType([T.StructField("entity", T.StringType()), T.StructField("at", T.ArrayType(T.LongType())),
                            T.StructField("hashes", T.ArrayType(T.StringType())), T.StructField("known", T.StringType())])
_STATE_SCHEMA = T.StructType([T.StructField("hash", T.StringType()), T.StructField("at", T.LongType()),
                              T.StructField("tiebreak", T.LongType())])


def _place(at: int, tiebreak: int | None) -> tuple:
    """Order of an entity's rows; a missing tiebreak comes last."""
    return at, tiebreak is None, tiebreak or 0


class ChangeDetector(StatefulProcessor):
    """Per entity: the last content hash and its (time, tiebreak). Emits
    where the hash of a new observation differs ('changed') or none is known
    ('new'), all of an entity's in one row. Rows of one micro-batch are
    ordered by (time, tiebreak) first; rows not after the stored place are
    late and change nothing. A data frame or an output row for each of them
    would cost many times the work itself.

    With ``expires``, what is known of an entity ends when the watermark
    reaches its time. One timer an entity is pending as long as it has state:
    when it fires, it is set again for the newer time seen since, or the state
    goes."""

    def __init__(self, ttl_ms: int | None, expires: bool = False) -> None:
        self.ttl_ms = ttl_ms
        self.expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE_SCHEMA, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = sorted(((_place(r.at, r.tiebreak), r.content_hash) for r in rows), key=itemgetter(0))
        held = known = self.last.get() if self.last.exists() else None
        if known and self.expires and known[1] // 1000 <= timerValues.getCurrentWatermarkInMs():
            known = None
        if known:
            place = _place(known[1], known[2])
            new = [r for r in new if r[0] > place]
        first = prev = known[0] if known else None
        at, hashes = [], []
        for place, h in new:
            if h != prev:
                at.append(place[0])
                hashes.append(h)
            prev = h
        if new:
            end, missing, tiebreak = new[-1][0]
            self.last.update((prev, end, None if missing else tiebreak))
            if self.expires and not held:
                self.handle.registerTimer(end // 1000)
        return iter([Row(entity=key[0], at=at, hashes=hashes, known=first)] if at else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            at = self.last.get()[1] // 1000
            if at > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(at)
            else:
                self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_changes(df: DataFrame, entity: str, ts: str, chash: str, tiebreak: str | None = None,
                   ttl_days: int | None = None, expire_days: int | None = 30) -> DataFrame:
    """STR-4: changes of an entity's content hash across the stream, with
    keyed state (last hash + place). Rows without a time or a hash are left
    out. Bound a micro-batch with ``max_files_per_trigger``.

    An entity not seen for ``expire_days`` of the stream's own time is
    forgotten, and 'new' when it comes back: the watermark follows the newest
    row by that much, and timers on it end the state, under ``AvailableNow``
    too. Rows older than the watermark are left out. With None for it state is
    kept for good; it does not count beside ``ttl_days``.

    ``ttl_days`` (e.g. 30) expires an entity's state after that long without
    updates; it needs processing-time mode, so use it with a continuous
    (processing-time) trigger: under ``AvailableNow`` pending expiries keep
    the query scheduling empty batches and it would not stop."""
    src = df.select(qcol(entity).cast("string").alias("entity"), qcol(ts).alias("ts"),
                    qcol(chash).alias("content_hash"),
                    (qcol(tiebreak) if tiebreak else F.lit(0)).cast("long").alias("tiebreak")) \
        .filter(F.col("ts").isNotNull() & F.col("content_hash").isNotNull())
    ttl = ttl_days * 24 * 3600 * 1000 if ttl_days else None
    expires = bool(expire_days) and not ttl
    if expires:
        src = src.withWatermark("ts", f"{expire_days} days")
    found = src.withColumn("at", F.unix_micros("ts")).groupBy("entity").transformWithState(
        statefulProcessor=ChangeDetector(ttl, expires), outputStructType=_OUT_SCHEMA,
        outputMode="Append", timeMode="ProcessingTime" if ttl else "EventTime" if expires else "None")
    prev = F.when(F.col("i") > 0, F.get("hashes", F.col("i") - 1)).otherwise(F.col("known"))
    return found.select("*", F.posexplode("at").alias("i", "micros")).select(
        "entity", F.timestamp_micros("micros").alias("ts"), F.get("hashes", F.col("i")).alias("content_hash"),
        prev.alias("prev_hash"), F.when(F.coalesce(prev, F.lit("")) == "", "new").otherwise("changed").alias("change"))


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> str:
    """Drain a streaming DataFrame into a Parquet folder (AvailableNow) and
    wait for it; the result is then an ordinary table."""
    q = (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return path


def table_stream(spark: SparkSession, folder: str, name: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over one table file of a folder (``<folder>/<name>.parquet``),
    with naive timestamps read as session-zone timestamps.
    ``max_files_per_trigger`` bounds a micro-batch (and so the rows of one
    key handed to a stateful handler at once)."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").schema
    glob = f"{folder.rstrip('/')}/{name[:-1]}[{name[-1]}].parquet"
    reader = spark.readStream.schema(schema).option("basePath", folder)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.parquet(glob)
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz"
                       else F.col(f.name) for f in schema.fields])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Start stateful queries (STR-4) on the RocksDB state store when the
    session names no provider of its own; its setting is put back after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    current = spark.conf.get(key, None)
    if current and not current.endswith("HDFSBackedStateStoreProvider"):
        yield
        return
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if current is None else spark.conf.set(key, current)


def run_waves(waves: list[DataFrame], folder: str, job, path: str, checkpoint: str) -> str:
    """Append each batch ``DataFrame`` of ``waves`` to ``folder`` in turn and
    drain ``job(stream over folder)`` into ``path`` after each: every run
    resumes from the checkpoint and sees one wave of new files."""
    spark = waves[0].sparkSession
    for wave in waves:
        wave.write.mode("append").parquet(folder)
        run_to_table(job(spark.readStream.schema(wave.schema).parquet(folder)), path, checkpoint)
    return path
