"""SimHash fingerprints linked by multi-index hashing.

A fingerprint has 64 bits cut into ``segments`` equal parts. Two fingerprints
that differ in at most ``distance`` bits differ in at most ``distance //
segments`` bits of some part. The table holds each distinct fingerprint once
per part, keyed by the part's value; each also asks for every value in the
small Hamming ball around its own part. Matches are verified on all 64 bits.
Only distinct fingerprints are looked up, so equal texts never make pairs, and
one fingerprint has at most as many partners as its ball of ``distance`` bits
holds, whatever the corpus.

Edge cases: a null text counts as empty; texts without words have fingerprint
zero and link like any other; texts of fewer words than a shingle are one
shingle; a null ``doc_id`` belongs to its component but names it only if all
are null (then ``component_id`` is null); repeated rows come out once each;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.arrays import blocks, text_of
from strata.llm.graph import components
from strata.session import materialize

SHINGLE, DISTANCE, SEGMENTS, SEED = 3, 3, 2, 42
#: Bytes of text at a time: the votes take up to 8 bytes a bit of every hash.
BLOCK = 1 << 19


def shingle_hashes(text: str, k: int = SHINGLE) -> list[int]:
    words = text.encode().lower().split()  # bytes: A-Z only, and the six separators only
    if not words:
        return []
    if len(words) < k:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(w), SEED) for w in zip(*(words[i:] for i in range(k)), strict=False)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, digest: bool = False) -> DataFrame:
    """``(doc_id, fp)``: a bit is set if it is set in over half the hashes.
    With ``digest`` also ``sha``, the text's."""
    names = ["doc_id", "sha", "fp"] if digest else ["doc_id", "fp"]

    def work(batches):
        for batch in batches:
            texts, ids = text_of(batch), batch.column("doc_id")
            for a, b in blocks(texts, BLOCK):
                each = [shingle_hashes(t, shingle) for t in texts.slice(a, b - a).to_pylist()]
                n = np.array([len(x) for x in each], np.int64)
                out = np.zeros(b - a, np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    h = np.array([x for e in each for x in e], np.uint64)
                    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                    votes = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
                    out[some] = np.packbits(votes * 2 > n[some][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
                sha = [batch.column("sha").slice(a, b - a)] if digest else []
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *sha, pa.array(out.view(np.int64))], names=names)

    more = [_sha("text").alias("sha")] if digest else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(
        work, "doc_id long, " + "sha binary, " * digest + "fp long")


def _sha(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), 256))


def ball(bits: int, radius: int) -> list[int]:
    """The masks that change at most ``radius`` of ``bits`` bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct ``fp`` at most ``distance``
    bits apart."""
    width = 64 // segments
    if segments * width != 64:
        raise ValueError("64 must be a multiple of segments")
    low = (1 << width) - 1
    masks = F.array(*[F.lit(m) for m in ball(width, distance // segments)])
    part = lambda c, s: F.shiftrightunsigned(c, s * width).bitwiseAND(F.lit(low))
    keyed = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), part(F.col("fp"), s).alias("value"))
                                for s in range(segments)])).alias("k")
    own = prints.select("fp", keyed)
    table = own.select("k.seg", "k.value", F.col("fp").alias("b"))
    asked = own.select("k.seg", F.explode(F.transform(masks, lambda m: F.col("k.value").bitwiseXOR(m))).alias("value"),
                       F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return asked.join(table.hint("shuffle_merge"), ["seg", "value"]).where((F.col("a") < F.col("b")) & near) \
        .select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                    segments: int = SEGMENTS, digest: bool = False) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``, with ``digest``
    also ``sha``."""
    rows = materialize(fingerprints(docs, shingle, digest), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    joined = components(links(prints, distance, segments))
    member = prints.join(joined, prints["fp"] == joined["node"], "left") \
        .select("fp", "first", F.coalesce("component", "fp").alias("component"))
    member = materialize(member, "members")
    names = member.groupBy("component").agg(F.min("first").alias("component_id"))
    names = member.join(names, "component").select("fp", "component_id")
    return rows.join(names, "fp").select(*rows.columns, "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that name their component:
    one document of each group. Rows that share a ``doc_id`` and a group are one
    document. Only the ids and text digests of rows that go are joined back:
    an id alone may stand for other texts, in groups of their own."""
    rows = near_duplicates(docs, shingle, distance, segments, digest=True)
    gone = rows.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))) \
        .select(F.col("doc_id").alias("__gone"), F.col("sha").alias("__sha")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["__gone"]) & (_sha("text") == gone["__sha"])
    return docs.join(gone, same, "left_anti")
