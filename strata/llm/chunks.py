"""Document fingerprints by content-defined chunking.

A rolling gear hash over the bytes of a text puts a boundary where its top
bits are zero; normalised: more bits are asked for before the mean chunk
length and fewer after it, so lengths gather around the mean. The hash at a
place depends on the 16 bytes before it alone, and no chunk is shorter, so an
insertion moves the boundaries near it only. A fingerprint is the set of chunk
digests with their lengths; likeness is containment: the share of a text's
chunk bytes that the other has too.

Edge cases: a null or empty text has the empty fingerprint, alike (1.0) to
another empty one and unlike (0.0) all else; a null ``doc_id`` sorts first;
rows that share a ``doc_id`` are ordered by text; a single row is its own next
row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.arrays import blocks, mix, text_of
from strata.session import materialize

MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 16, 64, 256

_GEAR = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x6EA2)).astype(np.uint32)
_BITS = MEAN_CHUNK.bit_length() - 1
Print = dict[int, int]


def _boundaries(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks that the strict and the loose test allow."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):  # the sum over the last 2k bytes from two sums over k
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return np.flatnonzero(h >> np.uint32(31 - _BITS) == 0) + 1, np.flatnonzero(h >> np.uint32(33 - _BITS) == 0) + 1


def prints(texts: list[bytes]) -> list[Print]:
    """Digest to length of each text's chunks."""
    whole = b"".join(texts)
    if not whole:
        return [{} for _ in texts]
    strict, loose = (x.tolist() for x in _boundaries(np.frombuffer(whole, np.uint8)))
    strict.append(len(whole) + MAX_CHUNK)
    loose.append(len(whole) + MAX_CHUNK)
    digest, out, at = xxhash.xxh64_intdigest, [], 0
    for t in texts:
        own: Print = {}
        end = at + len(t)
        while at < end:
            cut = strict[bisect_left(strict, at + MIN_CHUNK)]
            if cut >= at + MEAN_CHUNK:
                cut = loose[bisect_left(loose, at + MEAN_CHUNK)]
            cut = min(cut, at + MAX_CHUNK, end)
            own[digest(whole[at:cut]) >> 16] = cut - at
            at = cut
        out.append(own)
    return out


def show(p: Print) -> str:
    return " ".join(f"{d:012x}:{n:x}" for d, n in sorted(p.items()))


def containment(a: Print, b: Print) -> float:
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def _edit(text: str, nxt: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + nxt[:half]


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _compare(ids: list, texts: list[str]) -> list[tuple]:
    """Result rows of all but the last, each against the next."""
    raw = [t.encode() for t in texts]
    own = prints(raw)
    edits = [_edit(t, n).encode() for t, n in zip(texts, texts[1:], strict=False)]
    other = prints(edits)
    return [(ids[i], len(texts[i]), hashlib.sha256(edits[i]).hexdigest(), show(own[i]), show(other[i]),
             containment(own[i], other[i]), containment(own[i], own[i + 1])) for i in range(len(edits))]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text (the last half
    replaced by the start of the next document in order of ``doc_id``), and
    their likeness. Texts are dealt once by ranges of ``doc_id``; only each
    range's first and last document are matched afterwards."""
    names = [c.split()[0] for c in OUT.split(", ")]

    def rows_out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)]
            + [pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())],
            names=[*names, "text", "edge", "begin"])

    def edge(doc, text: str, which: str, begin) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([doc], pa.int64()), *(pa.nulls(1, k) for k in _KINDS[1:]),
             pa.array([text]), pa.array([which]), pa.array([begin], pa.int64())], names=[*names, "text", "edge", "begin"])

    def work(batches):
        ids, texts = [], []  # the row before
        first = None
        for batch in batches:
            all_texts, all_ids = text_of(batch), batch.column("doc_id").to_pylist()
            for a, e in blocks(all_texts):
                ids, texts = ids + all_ids[a:e], texts + all_texts.slice(a, e - a).to_pylist()
                first = first or (ids[0], texts[0])
                if len(ids) > 1:
                    yield rows_out(_compare(ids, texts))
                ids, texts = ids[-1:], texts[-1:]
        if first:
            yield edge(*first, "first", first[0])
            yield edge(ids[0], texts[0], "last", first[0])

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = materialize(ranged.mapInArrow(work, OUT + ", text string, edge string, begin long"), "fingerprints")
    first = done.where("edge = 'first'").select(F.col("begin").alias("follows"), F.col("text").alias("next_text"))
    last = done.where("edge = 'last'").select("doc_id", "text", "begin")
    # two rows a range: its last document goes with the next range's first, the very last with the very first
    begin = [r["follows"] for r in first.select("follows").collect()]  # one id a range
    begin.sort(key=lambda x: (x is not None, x or 0))
    follows = done.sparkSession.createDataFrame(list(zip(begin, begin[1:] + begin[:1], strict=True)),
                                                "own long, after long")

    def finish(batches):
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text"))
            yield rows_out([_compare([i, None], [t, n])[0] for i, t, n in zip(*cols, strict=True)]).select(names)

    ends = last.join(F.broadcast(follows), F.col("begin").eqNullSafe(F.col("own"))) \
        .join(first, F.col("after").eqNullSafe(F.col("follows"))).select("doc_id", "text", "next_text") \
        .mapInArrow(finish, OUT)
    return done.where("edge is null").select(*names).unionByName(ends)
