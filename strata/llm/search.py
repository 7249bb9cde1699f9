"""Ranked lexical search, a term at a time with limited accumulators.

Every text of ``items`` is a query against all ``docs``. Terms are maximal
runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A
document's score for an item sums, over the item's terms with repeats,

    w * ((1000000000 * tf) div (1000 * tf + 12 * m)),
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))),  m = 75 + (25 * n * N) div L

with N documents that have a term, L terms in all, n terms in the document,
df documents with the term and tf its count in the document.

An item's terms are taken rarest first, in rounds. While a document without
an accumulator can still reach the item's k-th best partial score by the terms
that remain (each bounded by its best document), a round adds accumulators for
all documents of its terms. After that none is added; accumulators that cannot
reach the k-th partial score even by all bounds go, and the rest, the
survivors, get the remaining terms exactly. The bounds are strict, so ties are
never lost, and frequent terms make no accumulators of their own.

The documents are read once, into a table of one row a document with the terms
that some item has (all are counted for n). What a task gets of the items is a
bitmap of a fixed size and, up to ``MAX_PAIRS`` (item, term) pairs, the round's
pairs by broadcast; beyond that they are joined by a shuffle.

Edge cases: null or empty texts have no term, so such items return no row and
such documents are in no result; repeated documents are ranked each on its own
row; equal scores go by ascending ``doc_id`` (null last); repeated rows of
``items`` (equal id and text) are one item, equal ids with other texts are
items of their own; long texts are read whole; extra columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.arrays import Block, blocks, runs, signed, text_of
from strata.llm.tokens import bitmap, hashes, may_hold, numbered
from strata.session import materialize

TOP = 20
#: An item's terms, rarest first, are dealt to rounds that end at these ranks.
ROUNDS = (6, 12, 18, 24, 32, 64)
MAX_PAIRS = 200_000

_INSIDE = np.zeros(256, bool)
_INSIDE[0x80:] = True
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _INSIDE[_a:_b + 1] = True


def term_counts(docs: DataFrame, id_column: str, wanted: np.ndarray | None = None) -> DataFrame:
    """``(id, row, n, terms, hashes, tfs)`` per row of ``docs``: ``n`` terms in
    all, and of those whose hash is in the bitmap ``wanted`` the distinct ones
    with their counts. ``row`` is unique."""

    def work(batches):
        next_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, ids = text_of(batch), batch.column("id")
            for a, b in blocks(texts):
                block = Block(texts, a, b)
                block.lower()
                starts, ends = runs(_INSIDE[block.data], block.off)
                edge = np.searchsorted(starts, block.off)
                doc = np.repeat(np.arange(block.n), np.diff(edge))
                number, words = numbered(block.data, starts, ends)
                h = hashes(words)
                if wanted is not None:
                    use = may_hold(wanted, h)[number]
                    doc, number = doc[use], number[use]
                pair, tf = np.unique(doc * max(len(words), 1) + number, return_counts=True)
                doc, number = pair // max(len(words), 1), pair % max(len(words), 1)
                off = pa.array(np.searchsorted(doc, np.arange(block.n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, v) for v in (
                    words.take(pa.array(number)).cast(pa.string()), pa.array(signed(h[number])), pa.array(tf.astype(np.int64)))]
                rows = pa.array(np.arange(next_row, next_row + block.n))
                next_row += block.n
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), rows, pa.array(np.diff(edge).astype(np.int64)), *lists],
                                                 names=["id", "row", "n", "terms", "hashes", "tfs"])

    return docs.select(F.col(id_column).cast("long").alias("id"), "text").mapInArrow(
        work, "id long, row long, n long, terms array<string>, hashes array<long>, tfs array<long>")


def _exploded(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select(
        *keep, F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf"))


def _limited(pairs: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(pairs) if few else pairs


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, rounds: tuple[int, ...] = ROUNDS,
         doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best documents of every
    item with a score above 0."""
    asked = materialize(term_counts(items.select(item_id, "text").distinct(), item_id)
                        .select("id", F.col("row").alias("q"), "terms", "hashes", "tfs"), "items")
    wanted = bitmap(asked.select(F.explode("hashes").alias("h")), "h")
    forward = materialize(term_counts(docs, doc_id, wanted).drop("hashes").where("n > 0"), "forward")
    total = forward.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 1
    shape = F.expr(f"75 + (25 * n * {n_docs}L) div {n_terms}L").alias("m")
    forward = forward.select("id", "row", "terms", "tfs", shape)

    pairs = _exploded(asked, "q").withColumnRenamed("tf", "qtf")
    few = pairs.count() <= MAX_PAIRS
    gain = F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)")
    seen = _exploded(forward, "m").groupBy("term").agg(F.count("*").alias("df"), F.max(gain).alias("best"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    order = Window.partitionBy("q").orderBy("df", "term")
    ends = F.array(*[F.lit(r) for r in rounds])
    after = order.rowsBetween(1, Window.unboundedFollowing)
    pairs = pairs.join(seen, "term").select("q", "term", "df", (F.col("qtf") * weight).alias("w"), "best") \
        .where("w > 0")
    pairs = pairs.select("q", "term", "w", (F.row_number().over(order) - 1).alias("at"),
                         F.coalesce(F.sum(F.col("w") * F.col("best")).over(after), F.lit(0)).alias("left"))
    pairs = pairs.select("q", "term", "w", "left", F.size(F.filter(ends, lambda e: e <= F.col("at"))).alias("round"))
    pairs = materialize(pairs, "pairs")
    last = pairs.agg(F.max("round").alias("m")).first()["m"]
    last = -1 if last is None else last

    names = asked.select("q", F.col("id").alias("item_id"))
    # what remains after a round: the bound left by the round's last term
    bounds = pairs.groupBy("q", "round").agg(F.min("left").alias("left"))
    active, acc, done = asked.select("q"), None, None
    best = Window.partitionBy("q").orderBy(F.col("score").desc())
    for r in range(last + 1):
        now = pairs.where(F.col("round") == r).join(active, "q", "left_semi").select("q", "term", "w")
        made = _exploded(forward, "row", "m").join(_limited(now, few), "term") \
            .groupBy("q", "row").agg(F.sum(F.col("w") * gain).alias("score"))
        if acc is not None:
            made = made.union(acc).groupBy("q", "row").agg(F.sum("score").alias("score"))
        acc = materialize(made, "accumulators")
        kth = acc.withColumn("k", F.row_number().over(best)).where(F.col("k") <= top).where(F.col("k") == top) \
            .select("q", F.col("score").alias("kth"))
        state = active.join(bounds.where(F.col("round") == r).drop("round"), "q", "left") \
            .join(kth, "q", "left").select("q", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("kth", F.lit(0)).alias("kth"))
        state = materialize(state.withColumn("goes_on", F.col("left") >= F.greatest("kth", F.lit(1))), "state")
        ended = state.where(~F.col("goes_on"))
        alive = acc.join(_limited(ended, few), "q").where(F.col("score") + F.col("left") >= F.col("kth")) \
            .select("q", "row", "score", F.lit(r).alias("round"))
        done = alive if done is None else done.union(alive)
        active = state.where("goes_on").select("q")
        acc = acc.join(_limited(active, few), "q", "left_semi")
        if r < last and active.isEmpty():
            break
    if done is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    done = materialize(done, "survivors")
    rest = done.select("row", "q", "round").join(forward.drop("id"), "row")
    rest = _exploded(rest, "row", "q", "round", "m").join(
        _limited(pairs.select("q", "term", "w", F.col("round").alias("late")), few), ["q", "term"]) \
        .where(F.col("late") > F.col("round")).select("q", "row", (F.col("w") * gain).alias("score"))
    full = done.select("q", "row", "score").union(rest).groupBy("q", "row").agg(F.sum("score").alias("score"))
    ranked = full.where("score > 0").join(forward.select("row", F.col("id").alias("doc_id")), "row").withColumn(
        "rank", F.row_number().over(Window.partitionBy("q").orderBy(
            F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row"))).where(F.col("rank") <= top)
    return ranked.join(names, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
