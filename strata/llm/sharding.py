"""Resharding that moves the fewest bytes, by minimum-cost flow.

A sharded table is a folder of Parquet files, ``shard=../tier=../part=..``. A
row's ``tier`` falls with its size (63 minus the bits of its bytes), so that a
shard's order, by tier, part and ``place``, ends with its small rows; ``part``
and ``place`` come from a hash of the row's file and number, so equal rows and
equal ids spread like any others.

``reshard`` takes the old shards' bytes and the new shards' capacities and
solves a transport problem: old shard i sends f(i, j) bytes to new shard j, at
``cost(i, j)`` a byte (0 to stay, 1 to move, unless given), by successive
shortest paths over integers. An old shard's order is then cut into runs of
f(i, j) bytes, what stays first. A folder inside one run goes there whole;
folders on a cut are counted again by ``PLACES`` blocks, and a block on a cut
goes where most room is left. Only folders that lose rows are rewritten, as
files of the new shards in a folder of their own; all others stay as they
are, and ``resharded`` returns both. A run that is repeated takes a new folder.

The driver holds sizes by folder (shards x 64 tiers x ``PARTS`` at most), by
block of folders on a cut (at most shards + new shards of those), and the
flow; rows never leave the executors, and a row crosses the network once when
it is first written and once if it moves.

Edge cases: a null text has 0 bytes (plus ``OVERHEAD``); null and repeated ids
and rows are rows like others; a row larger than a shard's share leaves that
shard above it, alone at its end of the order; very long texts are moved whole;
extra columns, whatever their names, travel in one struct; an empty table has
shards without rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from strata.session import materialize

OVERHEAD = 8
PARTS, PLACES = 4, 4096

FOLDER = ["shard", "tier", "part"]
_BLOCK = "shard int, tier int, part int, low int, high int, target int"


def minimum_cost_flow(supply: list[int], capacity: list[int],
                      cost: Callable[[int, int], int] | None = None) -> list[list[int]]:
    """f[i][j] >= 0 with row sums ``supply`` and column sums of at most
    ``capacity``, of the least total cost. Successive shortest paths
    (Bellman-Ford on the residual graph of sources, sinks and their arcs)."""
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are smaller than what there is to place")
    cost = cost or (lambda i, j: int(i != j))
    rows, cols = range(len(supply)), range(len(capacity))
    price = [[cost(i, j) for j in cols] for i in rows]
    flow = [[0] * len(capacity) for _ in rows]
    give, room = list(supply), list(capacity)
    while any(give):
        far: list = [0 if g else None for g in give]  # cheapest way to each old shard
        reach: list = [None] * len(capacity)
        came, via = [None] * len(supply), [None] * len(capacity)
        changed = True
        while changed:
            changed = False
            for i in rows:
                if far[i] is None:
                    continue
                for j in cols:
                    d = far[i] + price[i][j]
                    if reach[j] is None or d < reach[j]:
                        reach[j], via[j], changed = d, i, True
            for j in cols:
                if reach[j] is None:
                    continue
                for i in rows:
                    if flow[i][j] and (far[i] is None or reach[j] - price[i][j] < far[i]):
                        far[i], came[i], changed = reach[j] - price[i][j], j, True
        end = min((j for j in cols if room[j]), key=lambda j: reach[j])
        path, j, amount = [], end, room[end]
        while True:
            i = via[j]
            path.append((i, j, 1))
            if came[i] is None:
                amount = min(amount, give[i])
                break
            j = came[i]
            path.append((i, j, -1))
            amount = min(amount, flow[i][j])
        for i, j, sign in path:
            flow[i][j] += sign * amount
        give[path[-1][0]] -= amount
        room[end] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    """Whole bytes, at most one apart."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def size_of(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def write_shards(docs: DataFrame, path: str, shards: int, by: Column) -> str:
    """Writes ``docs`` as ``shards`` shards: a row's is the hash ``by`` modulo
    their number. A table that is not read from files is written first, so
    that a row's place never depends on how it was computed."""
    if "_metadata" not in docs.columns:
        try:
            docs.select("_metadata.row_index")
        except AnalysisException:
            docs = materialize(docs, "unsharded")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    own = F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size_of("text").alias("size"),
                       F.crc32(raw).alias("crc"), F.pmod(by, F.lit(shards)).cast("int").alias("shard"), own.alias("own"))
    rows = rows.select("row", "size", "crc", "shard", (F.lit(63) - F.length(F.bin("size"))).alias("tier"),
                       F.pmod(F.shiftright("own", 16), F.lit(PARTS)).cast("int").alias("part"),
                       F.pmod("own", F.lit(PLACES)).cast("int").alias("place"))
    rows.hint("rebalance", *FOLDER).write.option("compression", "zstd").partitionBy(*FOLDER).parquet(path)
    return path


def table(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """The sharded table at ``path`` of rows like those of ``docs``."""
    shape = StructType([StructField("row", docs.schema), *[StructField(c, LongType()) for c in ("size", "crc")],
                        *[StructField(c, IntegerType()) for c in ("place", *FOLDER)]])
    return spark.read.schema(shape).parquet(path)


def _sizes(rows: DataFrame, *by: str) -> list:
    return rows.groupBy(*by).agg(F.sum("size").alias("bytes")).orderBy(*by).collect()


def transfers(rows: DataFrame, capacity: list[int] | int, cost: Callable[[int, int], int] | None = None) -> list[tuple]:
    """Blocks ``(shard, tier, part, low, high, target)``: places ``low`` to
    ``high`` - 1 of that folder belong to ``target`` from now on. ``capacity``
    is bytes by new shard, or a number of shards to share all bytes equally."""
    folders = _sizes(rows, *FOLDER)
    total = sum(f["bytes"] for f in folders)
    if isinstance(capacity, int):
        capacity = equal_capacities(total, capacity)
    shards = sorted({f["shard"] for f in folders})
    held = {s: [f for f in folders if f["shard"] == s] for s in shards}
    cost = cost or (lambda i, j: int(i != j))
    flow = minimum_cost_flow([sum(f["bytes"] for f in held[s]) for s in shards], capacity,
                             lambda i, j: cost(shards[i], j))
    cuts = {}  # by old shard: (target, first byte, end byte), what stays first
    for s, sent in zip(shards, flow, strict=True):
        at, cuts[s] = 0, []
        for j in sorted(range(len(sent)), key=lambda j: (j != s, j)):
            if sent[j]:
                cuts[s].append((j, at, at + sent[j]))
                at += sent[j]
    on_cut = set()
    for s in shards:
        at = 0
        for f in held[s]:
            if sum(a < at + f["bytes"] and at < b for _, a, b in cuts[s]) > 1:
                on_cut.add((s, f["tier"], f["part"]))
            at += f["bytes"]
    finer: dict[tuple, list] = {k: [] for k in on_cut}
    if on_cut:
        spark = rows.sparkSession
        which = spark.createDataFrame(sorted(on_cut), "shard int, tier int, part int")
        for f in _sizes(rows.join(F.broadcast(which), FOLDER, "left_semi"), *FOLDER, "place"):
            finer[f["shard"], f["tier"], f["part"]].append((f["place"], f["place"] + 1, f["bytes"]))
    placed, open_blocks, room = [], [], list(capacity)
    for s in shards:
        at = 0
        for f in held[s]:
            key = (s, f["tier"], f["part"])
            for low, high, size in finer.get(key) or [(0, PLACES, f["bytes"])]:
                ends = [j for j, a, b in cuts[s] if a < at + size and at < b]
                if len(ends) > 1:
                    open_blocks.append((size, key, low, high, ends))
                else:
                    placed.append((*key, low, high, ends[0]))
                    room[ends[0]] -= size
                at += size
    for size, key, low, high, ends in sorted(open_blocks, key=lambda b: (-b[0], b[1:])):
        j = max(ends, key=lambda j: (room[j], j == key[0], -j))
        placed.append((*key, low, high, j))
        room[j] -= size
    out: list[tuple] = []
    for b in sorted(placed):
        if out and out[-1][:3] == b[:3] and out[-1][4] == b[3] and out[-1][5] == b[5]:
            out[-1] = (*out[-1][:4], b[4], b[5])
        else:
            out.append(b)
    return out


def reshard(old: DataFrame, capacity: list[int] | int, path: str,
            cost: Callable[[int, int], int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rewrites, to ``path``, every folder of the table ``old`` that loses
    rows. Returns those folders and the blocks that say where each went."""
    spark = old.sparkSession
    blocks = transfers(old, capacity, cost)
    lost = {b[:3] for b in blocks if b[5] != b[0]}
    rule = spark.createDataFrame([b for b in blocks if b[:3] in lost], _BLOCK)
    rows = old.join(F.broadcast(rule), FOLDER).where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
    rows.select("row", "size", "crc", "place", F.col("target").alias("shard"), "tier", "part") \
        .hint("rebalance", *FOLDER).write.option("compression", "zstd").partitionBy(*FOLDER).parquet(path)
    return rule.select(*FOLDER).distinct(), rule


def resharded(old: DataFrame, folders: DataFrame, moved: DataFrame) -> DataFrame:
    """``(row, size, crc, shard, slot)``: the folders of ``old`` that stay and
    the table ``moved``. ``slot`` counts a shard's rows from 0, file by file."""
    columns = ["row", "size", "crc", "shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    rows = old.select(*columns, "tier", "part").join(F.broadcast(folders), FOLDER, "left_anti") \
        .select("row", "size", "crc", "shard", "file", "at").union(moved.select(*columns))
    counts = rows.groupBy("shard", "file").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "file").select("row", "size", "crc", "shard", (F.col("start") + F.col("at")).alias("slot"))
