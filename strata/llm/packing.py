"""Best-fit packing with Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens; pieces go into as few
sequences as the method can. Only the histogram of piece lengths decides (at
most ``capacity`` rows, so its size is bounded whatever the corpus), and the
plan made from it is a table of runs: "pieces of this length, ranks a to b, go
to sequences s, s+1, ... at this offset". Spark ranks the pieces of a length
and joins them to the runs.

Dominance (Martello and Toth, 1990): for the longest piece left, if some set
of at most three pieces with it is at least as good as every other set that
fits beside it, some optimal packing holds that set; it is fixed and the
instance shrinks. What no such set covers is packed by best fit, longest
first.

Edge cases: a null or empty text is one piece holding only the end id; a null
``doc_id`` is kept as a document; repeated rows are packed each on their own;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strata.llm.arrays import blocks, text_of
from strata.llm.encode import Encoder
from strata.session import materialize

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUNS = "length long, first long, last long, sequence long, offset long"
#: Parts that rank the pieces of one length side by side.
PARTS = 1024


# ------------------------------------------------------------------ pieces

def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """Each document's ids (text, then ``end_id``) cut into pieces."""
    schema = PIECES + (", ids binary" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        enc = Encoder.at(tokenizer)
        for batch in batches:
            texts, ids = text_of(batch), batch.column("doc_id")
            for a, b in blocks(texts):
                rows: list[list] = [[] for _ in range(6)]
                for doc, tokens in zip(ids.slice(a, b - a).to_pylist(), enc.encode(texts.slice(a, b - a).to_pylist()),
                                       strict=True):
                    tokens += end
                    for k, at in enumerate(range(0, len(tokens), 4 * capacity)):
                        part = tokens[at:at + 4 * capacity]
                        for to, x in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                            to.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                k = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows[:k], kinds[:k], strict=True)],
                                                 names=names[:k])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


# -------------------------------------------------------------------- plan

class _Stock:
    """How many pieces of each length are left, and which ranks are taken."""

    def __init__(self, counts: dict[int, int]):
        self.left = {w: n for w, n in counts.items() if n > 0 and w > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.sorted = sorted(self.left)

    def take(self, w: int, n: int) -> int:
        first = self.used[w]
        self.used[w] += n
        self.left[w] -= n
        if not self.left[w]:
            self.sorted.remove(w)
        return first

    def at_most(self, room: int, but: int | None = None) -> int:
        """The longest length that fits (0: none); ``but`` is spent on another
        piece of the set, so one of that length more must be there."""
        i = bisect_right(self.sorted, room) - 1
        if i >= 0 and self.sorted[i] == but and self.left[but] < 2:
            i -= 1
        return self.sorted[i] if i >= 0 else 0

    def shortest(self, k: int, but: int) -> list[int]:
        """The k shortest pieces, without one of length ``but``."""
        out: list[int] = []
        for w in self.sorted:
            n = self.left[w] - (w == but)
            out += [w] * min(n, k - len(out))
            if len(out) == k:
                break
        return out


def dominating_set(stock: _Stock, w: int, capacity: int) -> tuple[int, ...] | None:
    """What to put beside the longest piece ``w`` if one set of at most two
    dominates all others that fit, else None."""
    room = capacity - w
    single = stock.at_most(room, but=w)
    if not single:
        return ()
    if single == room:
        return (single,)
    low = stock.shortest(3, w)
    if len(low) < 2 or low[0] + low[1] > room:
        return (single,)  # one piece at most fits, and this is the longest
    if len(low) > 2 and sum(low) <= room:
        return None  # three may fit: not decided here
    most = least = 0  # best sum of a pair, and the longest shorter half of any
    for y in stock.sorted:
        if 2 * y > room:
            break
        x = stock.at_most(room - y)
        spare = stock.left[x] - (x == w) - (x == y)
        while x and x >= y and spare < 1:
            i = bisect_right(stock.sorted, x - 1) - 1
            x = stock.sorted[i] if i >= 0 else 0
            spare = stock.left.get(x, 0) - (x == w) - (x == y)
        if x >= y and stock.left[y] - (y == w) >= 1:
            most, least = max(most, x + y), y
    if single >= most:
        return (single,)
    y = stock.at_most(room - single)
    if y and stock.left[y] - (y == w) - (y == single) >= 1 and y >= least:
        return (single, y)
    return None


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Runs (length, first rank, last rank exclusive, first sequence, offset)
    and the number of sequences, from how many pieces have each length."""
    stock, runs, nxt = _Stock(counts), [], 0
    # dominance: longest first; a length that no set decides is set aside
    for w in sorted(stock.left, reverse=True):
        while stock.left[w]:
            beside = dominating_set(stock, w, capacity)
            if beside is None:
                break
            need: dict[int, int] = {}
            for x in (w, *beside):
                need[x] = need.get(x, 0) + 1
            n = min(stock.left[x] // k for x, k in need.items())
            if beside:  # repeat only while the sets compared stay the same
                low = stock.shortest(3, w)
                if any(stock.left[x] - n * need.get(x, 0) < 3 for x in {*low, *need}) and beside != (capacity - w,):
                    n = 1
            at = 0
            for x in (w, *beside):
                first = stock.take(x, n)
                runs.append((x, first, first + n, nxt, at))
                at += x
            nxt += n
    # best fit, longest first, over what is left: open sequences by room
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, seq: int, n: int) -> None:
        if room and n:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((seq, n))

    for w in sorted((w for w, n in stock.left.items() if n), reverse=True):
        while n := stock.left[w]:
            i = bisect_right(rooms, w - 1)
            if i == len(rooms):
                each = min(capacity // w, n)
                full = n // each
                for k in range(each):
                    first = stock.take(w, full)
                    runs.append((w, first, first + full, nxt, k * w))
                put(capacity - each * w, nxt, full)
                nxt += full
                continue
            room = rooms[i]
            seq, there = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            m = min(n, there)
            first = stock.take(w, m)
            runs.append((w, first, first + m, seq, capacity - room))
            put(room - w, seq, m)
            put(room, seq + m, there - m)
    return runs, nxt


# -------------------------------------------------------------------- pack

def pack(pieces: DataFrame, capacity: int = CAPACITY, order: list[str | Column] | None = None) -> DataFrame:
    """``pieces`` (a written table with ``length``) with ``sequence_id`` and
    ``offset``. ``order`` must name columns that make equal rows alike."""
    spark = pieces.sparkSession
    order = order or [F.col(c) for c in pieces.columns]
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = plan_runs(counts, capacity)
    plan = F.broadcast(spark.createDataFrame(runs, RUNS))  # bounded by the number of lengths
    # rank within (length, part), then add what earlier parts of the length hold
    part = F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int")
    parts = pieces.groupBy("length", part.alias("part")).count()
    before = parts.select("length", "part", (F.sum("count").over(
        W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("count")).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "part").orderBy(*order))
    ranked = pieces.withColumn("part", part).withColumn("own", own) \
        .join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    return ranked.join(plan, (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("first"))
                       & (F.col("rank") < F.col("last"))) \
        .select(*[ranked[c] for c in pieces.columns],
                (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies. ``with_ids`` adds the ids themselves
    (little-endian unsigned 32-bit), from which a sequence is its pieces in
    order of ``offset``."""
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    return pack(pieces, capacity, order)
