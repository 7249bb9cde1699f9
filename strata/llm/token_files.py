"""Token files coded by a static range asymmetric numeral system (rANS).

Documents are dealt by ranges of ``doc_id`` and written in that order. A
segment is a run of documents with one shared frequency table (counts of its
ids scaled to 2**20, none below one); its ids are cut into independent blocks.
In a block, lane ``i`` codes ids i, i + lanes, i + 2 lanes ...: every step
codes one id a lane with array arithmetic. The lanes' renormalisation words
interleave in one stream, in the order the decoder takes them. Checkpoints
(all lanes' states and the place in the stream) let decoding begin inside a
block; a CRC-32 of the ids closes each block.

File format: a Parquet table, a row a segment: ``part, seq`` (order of the
segments), ``doc_ids, counts`` (the documents, in order), ``table`` (deflated
frequencies), ``blocks`` (binary, laid out as in :func:`encode_block`).

Edge cases: a null or empty text holds only the end id; a null ``doc_id``
sorts first; rows that share a ``doc_id`` are ordered by text; an empty table
gives no rows; extra columns are ignored. A segment always holds whole
documents, so a very long one may exceed ``SEGMENT``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strata.llm.arrays import blocks, text_of
from strata.llm.encode import Encoder

END_ID = 2
SCALE = 20
LANES, STEPS, CHECK_EVERY = 4096, 256, 128
SEGMENT = 2_000_000
_LOW = np.uint64(1 << 31)
_S, _32 = np.uint64(SCALE), np.uint64(32)
_SLOT, _WORD = np.uint64((1 << SCALE) - 1), np.uint64(0xFFFFFFFF)
_HEAD = struct.Struct("<4sIIIIII")  # magic, ids, lanes, checkpoint spacing, checkpoints, words, crc
MAGIC = b"rAN1"


# ------------------------------------------------------------------- table

def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE; what occurs keeps at least one."""
    seen = counts > 0
    f = np.zeros(len(counts), np.int64)
    f[seen] = np.maximum(1, counts[seen] * (1 << SCALE) // counts.sum())
    order = np.argsort(-f, kind="stable")
    over = int(f.sum()) - (1 << SCALE)
    while over > 0:  # taken from the most frequent, never below one
        take = np.minimum(np.maximum(f[order] // 2, 0), over)
        room = np.cumsum(take)
        take = np.where(room <= over, take, np.maximum(0, over - (room - take)))
        take = np.minimum(take, f[order] - 1).clip(0)
        f[order] -= take
        over -= int(take.sum())
    f[order[0]] -= over
    return f


class Table:
    def __init__(self, f: np.ndarray):
        self.f = f.astype(np.uint64)
        self.c = (np.cumsum(f) - f).astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            kind = np.uint16 if len(self.f) <= 1 << 16 else np.uint32
            self._symbol = np.repeat(np.arange(len(self.f), dtype=kind), self.f.astype(np.int64))
        return self._symbol

    def pack(self) -> bytes:
        return zlib.compress(self.f.astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, raw: bytes) -> Table:
        return cls(np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64))


# ------------------------------------------------------------------ blocks

def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECK_EVERY) -> bytes:
    n = len(ids)
    steps = -(-n // lanes)
    x = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    written, marks = 0, []
    f, c = table.f[ids], table.c[ids]
    for t in range(steps - 1, -1, -1):  # the decoder goes forward
        a, b = t * lanes, min(n, (t + 1) * lanes)
        y, ft = x[:b - a], f[a:b]
        full = y >= ft << np.uint64(63 - SCALE)
        if full.any():
            words.append((y[full] & _WORD).astype("<u4"))
            written += len(words[-1])
            y = np.where(full, y >> _32, y)
        q = y // ft
        x[:b - a] = (q << _S) + (y - q * ft) + c[a:b]
        if t % every == 0:
            marks.append((written, x.astype("<u8").tobytes()))
    stream = b"".join(w.tobytes() for w in reversed(words))
    marks = [struct.pack("<I", written - w) + s for w, s in reversed(marks)]
    return _HEAD.pack(MAGIC, n, lanes, every, len(marks), written, zlib.crc32(ids.astype("<u4").tobytes())) \
        + b"".join(marks) + stream


def decode_block(raw: bytes, table: Table, first: int = 0, end: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``end`` of a block (all by default, checked then)."""
    magic, n, lanes, every, n_marks, n_words, crc = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token block")
    end = n if end is None else min(end, n)
    size = 4 + 8 * lanes
    words = np.frombuffer(raw, "<u4", n_words, _HEAD.size + n_marks * size)
    if end <= first:
        return np.zeros(0, np.uint32)
    mark = first // lanes // every
    at = _HEAD.size + mark * size
    pos, = struct.unpack_from("<I", raw, at)
    x = np.frombuffer(raw, "<u8", lanes, at + 4).astype(np.uint64)
    start, stop = mark * every, -(-end // lanes)
    out = np.empty((stop - start) * lanes, np.uint32)
    for t in range(start, stop):
        m = min(lanes, n - t * lanes)
        y = x[:m]
        slot = y & _SLOT
        s = table.symbol[slot.astype(np.int64)]
        out[(t - start) * lanes:(t - start) * lanes + m] = s
        y = table.f[s] * (y >> _S) + slot - table.c[s]
        low = np.flatnonzero(y < _LOW)
        if pos + len(low) > n_words:
            raise ValueError("a token block's states do not close")
        if len(low):
            y[low] = (y[low] << _32) | words[pos:pos + len(low)].astype(np.uint64)
            pos += len(low)
        x[:m] = y
    out = out[first - start * lanes:end - start * lanes]
    if end == n and (x != _LOW).any():
        raise ValueError("a token block's states do not close")
    if first == 0 and end == n and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("a token block's checksum is wrong")
    return out


def encode_segment(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    table = Table(frequencies(np.bincount(ids)))
    size = LANES * STEPS
    return table.pack(), [encode_block(ids[a:a + size], table) for a in range(0, len(ids), size)]


# ------------------------------------------------------------------- files

FILES = "part int, seq int, doc_ids array<long>, counts array<long>, table binary, blocks array<binary>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment: int = SEGMENT) -> str:
    """Writes every document's ids and ``end_id`` in ascending ``doc_id``."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                        ("table", pa.binary()), ("blocks", pa.list_(pa.binary()))])

    def work(batches):
        enc = Encoder.at(tokenizer)
        docs_, parts, held, seq = [], [], 0, 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([np.frombuffer(p, "<u4") for p in parts])
            table, coded = encode_segment(ids)
            row = {"seq": seq, "doc_ids": docs_, "counts": [len(p) // 4 for p in parts], "table": table, "blocks": coded}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            texts = text_of(batch)
            for a, b in blocks(texts):
                for doc, ids in zip(batch.column("doc_id").slice(a, b - a).to_pylist(),
                                    enc.encode(texts.slice(a, b - a).to_pylist()), strict=True):
                    ids += end
                    if held and held + len(ids) // 4 > segment:
                        yield close()
                        docs_, parts, held, seq = [], [], 0, seq + 1
                    docs_.append(doc)
                    parts.append(ids)
                    held += len(ids) // 4
        if held:
            yield close()

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text") \
        .mapInArrow(work, FILES.replace("part int, ", "")) \
        .select(F.spark_partition_id().alias("part"), "*").write.parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, decoded from the
    files; ``start`` counts the ids of all documents before. ``with_ids`` adds
    the ids (little-endian unsigned 32-bit)."""
    files = spark.read.schema(FILES).parquet(path)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    sizes = files.select("part", "seq", total.alias("n"))  # a row a segment
    by_part = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # a row a range
    parts = by_part.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = W.partitionBy("part").orderBy("seq")
    starts = sizes.select("part", "seq", (F.sum("n").over(inside) - F.col("n")).alias("within")) \
        .join(parts, "part").select("part", "seq", (F.col("within") + F.col("before")).alias("start"))

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                get = lambda c: row.column(c)[0]  # noqa: B023, E731
                table = Table.unpack(get("table").as_py())
                ids = np.concatenate([decode_block(b.as_py(), table) for b in get("blocks")]).astype("<u4")
                counts = np.asarray(get("counts").values.to_numpy())
                at = np.concatenate([[0], np.cumsum(counts)])
                raw = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                n = len(raw)
                cols = [pa.array([get(c).as_py()] * n, pa.int32()) for c in ("part", "seq")]
                cols += [get("doc_ids").values, pa.array(at[:-1]), pa.array(counts),
                         pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = files.mapInArrow(work, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"
                            + (", ids binary" if with_ids else ""))
    return rows.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
