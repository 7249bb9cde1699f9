"""BPE encoding by tree concatenation, and decoding.

A text of more than ``leaf`` characters is halved until its parts are no
longer than that; the parts are encoded side by side, as rows of their own,
and joined pairwise up the tree. At a join the two sides' ids near the cut may
be wrong (a merge, a word end or a pattern may reach over it), so a window
around the cut is encoded anew. Where the window's tokens agree with the left
side's and, further on, with the right side's (same ids at the same
characters, two in a row), it is spliced in; until both agree it grows
twofold, at worst to the whole of both sides. A window's edges are moved
outward to places that no composed character, run of combining marks or
special token reaches over, and a side's tokens count only up to such a place
before (or after) the cut: the normaliser reorders marks over any distance.
Between such places neighbouring tokens that a BPE encoding put side by side
stay so in any longer text, which makes the splice exact.

Edge cases: a null text counts as empty and has no ids; a null ``doc_id``,
repeated rows and rows that share a ``doc_id`` come out once each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.arrays import blocks, text_of
from strata.llm.encode import Encoder

LEAF = 1 << 15
WINDOW = 64


class Tokens(NamedTuple):
    """Ids and the characters each covers."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def tokens_of(enc: Encoder, text: str) -> Tokens:
    e = enc.tok.encode(text, add_special_tokens=False)
    at = np.array(e.offsets, np.int64).reshape(-1, 2)
    return Tokens(np.array(e.ids, np.int64), at[:, 0], at[:, 1])


def pack_tokens(t: Tokens) -> tuple[bytes, bytes]:
    """Ids, and for each the characters skipped before it and those it covers."""
    gap = t.begin - np.concatenate([[0], t.end[:-1]])
    return t.ids.astype("<u4").tobytes(), np.stack([gap, t.end - t.begin]).astype("<i4").tobytes()


def unpack_tokens(ids: bytes, spans: bytes) -> Tokens:
    gap, size = np.frombuffer(spans, "<i4").reshape(2, -1).astype(np.int64)
    end = np.cumsum(gap + size)
    return Tokens(np.frombuffer(ids, "<u4").astype(np.int64), end - size, end)


@lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Characters that may compose with one before them: the second of any
    canonical pair, and the vowels and finals of Hangul."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    found = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}
    return frozenset(found | {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]})


def _stable(text: str, p: int, specials: tuple[str, ...]) -> bool:
    """No normalisation and no special token reaches over place ``p``: what is
    on either side there is the same with and without the other side."""
    if not 0 < p < len(text):
        return True
    c = text[p]
    if c > "\x7f" and (unicodedata.combining(c) or c in _seconds() or not unicodedata.is_normalized("NFC", c)
                       or unicodedata.combining(unicodedata.normalize("NFD", c)[0])):
        return False
    for s in specials:
        i = text.find(s, max(0, p - len(s) + 1), p + len(s) - 1)
        while 0 <= i < p:
            if p < i + len(s):
                return False
            i = text.find(s, i + 1, p + len(s) - 1)
    return True


def _outward(text: str, p: int, step: int, specials: tuple[str, ...]) -> int:
    while not _stable(text, p, specials):
        p += step
    return p


def _meet(side: Tokens, window: Tokens, low: int, high: int, from_end: bool) -> tuple[int, int] | None:
    """Two tokens in a row that both have, within characters low..high:
    (index in side, index in window)."""
    def keys(t: Tokens) -> dict[tuple, int]:
        a, b = np.searchsorted(t.begin, low), np.searchsorted(t.end, high, "right")
        return {(int(t.begin[i]), int(t.end[i]), int(t.ids[i]), int(t.end[i + 1]), int(t.ids[i + 1])): i
                for i in range(a, b - 1) if t.end[i] > t.begin[i] and t.end[i + 1] > t.begin[i + 1]}

    mine, other = keys(side), keys(window)
    both = mine.keys() & other.keys()
    if not both:
        return None
    best = max(both) if from_end else min(both)
    return mine[best], other[best]


def concatenate(enc: Encoder, text: str, cut: int, left: Tokens, right: Tokens, window: int = WINDOW) -> Tokens:
    """The tokens of ``text`` from those of ``text[:cut]`` and ``text[cut:]``."""
    right = Tokens(right.ids, right.begin + cut, right.end + cut)
    specials = tuple(t.content for t in enc.tok.get_added_tokens_decoder().values())
    # a side's own tokens hold up to here only: beyond, the other side may change its characters
    before, after = _outward(text, cut, -1, specials), _outward(text, cut, 1, specials)
    while True:
        a = _outward(text, max(0, min(before, cut - window)), -1, specials)
        b = _outward(text, min(len(text), max(after, cut + window)), 1, specials)
        mid = tokens_of(enc, text[a:b])
        mid = Tokens(mid.ids, mid.begin + a, mid.end + a)
        if a == 0 and b == len(text):
            return mid
        # the first tokens of a window may be wrong, so those further in decide
        head = (0, 0) if a == 0 else _meet(left, mid, a, before, from_end=False)
        tail = (len(right.ids), len(mid.ids)) if b == len(text) else _meet(right, mid, after, b, from_end=True)
        if head and tail and head[1] <= tail[1]:
            i, k = head
            j, m = tail
            return Tokens(*(np.concatenate([x[:i], y[k:m], z[j:]]) for x, y, z in zip(left, mid, right, strict=True)))
        window *= 2


def halves(text: str, leaf: int) -> list[str]:
    parts = [text]
    while any(len(p) > leaf for p in parts):
        parts = [h for p in parts for h in ((p[:len(p) // 2], p[len(p) // 2:]) if len(p) > 1 else (p, ""))]
    return parts


def join_tree(enc: Encoder, parts: list[str], tokens: list[Tokens]) -> Tokens:
    while len(parts) > 1:
        tokens = [concatenate(enc, parts[i] + parts[i + 1], len(parts[i]), tokens[i], tokens[i + 1])
                  for i in range(0, len(parts), 2)]
        parts = [parts[i] + parts[i + 1] for i in range(0, len(parts), 2)]
    return tokens[0]


def encode_text(enc: Encoder, text: str, leaf: int = LEAF) -> np.ndarray:
    """One text's ids by the tree, in this process."""
    parts = halves(text, leaf)
    return join_tree(enc, parts, [tokens_of(enc, p) for p in parts]).ids.astype("<u4")


# ----------------------------------------------------------------- columns

def encode_documents(docs: DataFrame, tokenizer: str, leaf: int = LEAF) -> DataFrame:
    """``(doc_id, ids)``: every whole text's ids as little-endian unsigned
    32-bit integers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def short(batches):
        enc = Encoder.at(tokenizer)
        for batch in batches:
            texts = text_of(batch)
            for a, b in blocks(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a),
                     pa.array(enc.encode(texts.slice(a, b - a).to_pylist()), pa.binary())], names=["doc_id", "ids"])

    def split(batches):
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = halves(text, leaf)
                row = hashlib.blake2b(text.encode(), digest_size=16).hexdigest()
                for i, p in enumerate(parts):
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": doc, "row": row, "leaf": i, "part": p}],
                        schema=pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("leaf", pa.int32()), ("part", pa.string())]))

    def encode(batches):
        enc = Encoder.at(tokenizer)
        for batch in batches:
            for i in range(batch.num_rows):
                t = tokens_of(enc, batch.column("part")[i].as_py())
                packed = [pa.array([x], pa.binary()) for x in pack_tokens(t)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, 1) for c in kept] + packed,
                                                 names=[*kept, "ids", "spans"])

    def join(batches):
        enc = Encoder.at(tokenizer)
        for batch in batches:
            for i in range(batch.num_rows):
                leaves = sorted(batch.column("leaves")[i].as_py(), key=lambda x: x["leaf"])
                ids = join_tree(enc, [x["part"] for x in leaves], [unpack_tokens(x["ids"], x["spans"]) for x in leaves]).ids
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, 1), batch.column("copies").slice(i, 1),
                     pa.array([ids.astype("<u4").tobytes()], pa.binary())], names=["doc_id", "copies", "ids"])

    kept = ["doc_id", "row", "leaf", "copies", "part"]
    leaf_key = ["doc_id", "row", "leaf"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = rows.where(F.length("text") > leaf)
    # equal rows share their leaves; dealt evenly, as encoding is the work here
    leaves = long.mapInArrow(split, "doc_id long, row string, leaf int, part string").repartition(parts, *leaf_key) \
        .groupBy(*leaf_key).agg(F.count("*").alias("copies"), F.first("part").alias("part")).select(*kept) \
        .mapInArrow(encode, "doc_id long, row string, leaf int, copies long, part string, ids binary, spans binary")
    # one list a document and text, of that document's own parts
    whole = leaves.groupBy("doc_id", "row").agg(F.first("copies").alias("copies"), F.collect_list(
        F.struct("leaf", "part", "ids", "spans")).alias("leaves"))
    joined = whole.select("doc_id", "copies", "leaves").mapInArrow(join, "doc_id long, copies long, ids binary") \
        .select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc_id", "ids")
    return rows.where(F.length("text") <= leaf).mapInArrow(short, "doc_id long, ids binary").unionByName(joined)


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with ``decoded``: the library's decoding of all ids, special
    tokens included."""
    def work(batches):
        enc = Encoder.at(tokenizer)
        bare = enc.tok.decoder is None
        names = [enc.tok.id_to_token(i) for i in range(enc.tok.get_vocab_size())] if bare else []
        for batch in batches:
            ids = batch.column("ids")
            for a in range(0, len(ids), 256):
                some = ids.slice(a, 256).to_pylist()
                if bare:  # without a decoder the tokens are joined by spaces
                    text = [" ".join([names[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in some]
                else:
                    text = enc.tok.decode_batch([np.frombuffer(x, "<u4").tolist() for x in some], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, 256) for c in batch.columns), pa.array(text, pa.string())],
                                                 names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(work, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
