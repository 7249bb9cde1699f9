"""Tokens of a block as numbers of the block's own dictionary, and bitmaps of
a fixed size that say which tokens may matter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.arrays import hash_spans

BITS = 22


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each ``data[start:end]``, the distinct strings by number).
    Strings are compared whole, not by a hash."""
    n = ends - starts
    off = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    step = np.ones(int(off[-1]), np.int32)  # a block is far below 2^31 bytes, an Arrow text too
    if len(n):
        step[0] = starts[0]
        step[off[1:-1]] = starts[1:] - ends[:-1] + 1
    flat = data[np.cumsum(step, dtype=np.int32)] if len(step) else np.zeros(0, np.uint8)
    words = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(flat)))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    values = words.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return hash_spans(data, off[:-1], off[1:], seed)


def bitmap(rows: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Which of 2^``bits`` buckets hold a hash of ``rows``: a bool array of
    that fixed size, or'ed together in Spark (32,768 buckets a row)."""
    bucket = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = rows.select(F.bitmap_bucket_number(bucket).alias("n"), F.bitmap_bit_position(bucket).alias("p")) \
        .groupBy("n").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts:
        out[(r["n"] - 1) * 4096:r["n"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return np.unpackbits(out, bitorder="little").astype(bool)


def may_hold(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    return table[(h & np.uint64(len(table) - 1)).astype(np.int64)]
