"""Text columns as flat byte arrays inside Arrow batches.

Shared by the operators that work on words or bytes of whole texts. A batch
is cut into blocks of whole rows of about ``BLOCK`` bytes, so that the
working arrays of a task stay small whatever Spark's batch size is; a single
longer text makes a block of its own. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK = 1 << 21
#: Fixed by the contracts: words are runs of anything but these bytes.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LONG = 512


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def blocks(texts: pa.Array, target: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(first row, end row) of consecutive blocks."""
    off = offsets(texts)
    first, n = 0, len(texts)
    while first < n:
        end = int(np.searchsorted(off, off[first] + target, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end
        first = end


def offsets(texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]


class Block:
    """The bytes of some rows, end to end: text ``i`` is ``data[off[i]:off[i + 1]]``."""

    def __init__(self, texts: pa.Array, first: int, end: int):
        off = offsets(texts)[first:end + 1]
        values = texts.buffers()[2] if len(texts) else None
        whole = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
        self.data = whole[off[0]:off[-1]]
        self.off = off - off[0]
        self.n = end - first

    def lower(self) -> None:
        self.data = _LOWER[self.data]

    def split(self) -> None:
        """Words: ``starts``, ``ends`` and, by text, ``woff`` into them."""
        word = ~_SPACE[self.data]
        starts, ends = runs(word, self.off)
        self.word, self.starts, self.ends = word, starts, ends
        self.woff = np.searchsorted(starts, self.off)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.woff))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.off[i]:self.off[i + 1]].tobytes()


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, cut at each text's edges."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[:-1][off[:-1] < off[1:]]
    first[edge] |= inside[edge]
    edge = off[1:][off[:-1] < off[1:]] - 1
    last[edge] |= inside[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``, eight bytes at a time."""
    n = ends - starts
    h = n.astype(np.uint64) * _M1 ^ np.uint64(seed)
    if not len(n):
        return h
    words = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(9, np.uint8)]), strides=(1,))
    pos, live = 0, np.flatnonzero((n > 0) & (n <= _LONG))
    if len(live) == len(n):  # the first eight bytes of all
        h = mix((h ^ (words[starts] & _MASK[np.minimum(n, 8)])) * _M1 + np.uint64(1))
        pos, live = 8, np.flatnonzero(n > 8)
    while len(live):
        left = np.minimum(n[live] - pos, 8)
        limb = words[starts[live] + pos] & _MASK[left]
        h[live] = mix((h[live] ^ limb) * _M1 + np.uint64(pos + 1))
        pos += 8
        live = live[n[live] > pos]
    for i in np.flatnonzero(n > _LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes(), seed & 0xFFFFFFFF)
    return h


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """One number for each ``k`` neighbours of ``h``. More than three: the sum
    of ``h[i + j] * _M1 ** (k - 1 - j)``, put together from sums of 1, 2, 4 ..."""
    n = len(h) - k + 1
    acc = np.zeros(n, np.uint64)
    if k <= 3:
        for i in range(k):
            acc = mix((acc ^ h[i:i + n]) * _M1 + np.uint64(i + 1))
        return acc
    part, size, done = h, 1, 0
    while True:
        up = np.uint64(pow(int(_M1), size, 1 << 64))
        if k & size:
            acc = acc * up + part[done:done + n] if done else part[:n]
            done += size
        if done == k:
            return acc
        part, size = part[:-size] * up + part[size:], 2 * size


def windows(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that stay in one text, and where each
    begins (an index of words)."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = _rolled(h, k)
    counts = np.diff(woff)
    room = np.maximum(counts - k + 1, 0)
    at = np.repeat(woff[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
    return mix(acc[at]), at


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets; empty stretches give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]
