"""Removing repeated passages by level-wise doubling of window lengths.

A window of ``window`` words is removed from a document when the same words
start in a document with a smaller ``doc_id``. Finding out by hashing every
window of that length would move every word of the corpus; instead lengths
double, and only what repeats at one length is looked at at twice that length:

* level 0, ``anchor`` words (half the window): of the short windows inside
  each window only the one with the smallest hash is an anchor, so equal
  windows have equal anchors, and neighbouring windows mostly share one.
  Anchors seen in one document alone end here, with the windows around them.
* level 1, ``window`` words: windows around repeated anchors; those that also
  start in an earlier document are hits.
* neighbouring windows that survive make a stretch. What documents with an equal
  stretch have in common is settled by its digest: all its windows, of all
  lengths, repeat. Only one stretch of each kind goes on.
* further levels make windows of twice the length from two repeated halves, for
  as long as any survive that stretches of different words share. Words go by
  the longest windows found: a hit that a hit of the next level begins or ends
  with is not reported again.

Equal documents are settled first, by a digest of their word sequence, so a
group of copies costs one row a copy. Texts cross a shuffle twice: to their
repeated anchors, and to their hits. Both times a row is found by ``row``, 64
bits of its id and text, and then known by 96 bits of its words' digest: what
rows under one (null) id repeat stays apart. An anchor or a window crosses one
shuffle to its equals, as a few numbers: its document, its place (see
:func:`_bases`) and its digest. Of those that several ids of one block have,
only the smallest id's and one more go there; the others are known to repeat.

Edge cases: a null or empty text has no words; ``doc_id`` null sorts after
every other and takes no words from others; rows that share a ``doc_id`` take
none from each other; repeated rows come out once each; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.arrays import Block, blocks, hash_spans, mix, signed, text_of, windows
from strata.llm.skew import split_join
from strata.session import free_shuffles, materialize

WINDOW, ANCHOR = 13, 6
#: Stands for a null ``doc_id`` in comparisons: larger than any other.
NO_ID = (1 << 63) - 1


def _lowest(x: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` neighbours."""
    size = 1
    while size < span:
        step = min(size, span - size)
        x, size = np.minimum(x[:-step], x[step:]), size + step
    return x


def _anchors(h: np.ndarray, woff: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """All anchors: (hash, text, first, last), where windows starting at words
    first..last (within the text) choose this one, or an equal one beside it."""
    counts = np.maximum(np.diff(woff) - window + 1, 0)  # windows a text
    total = int(counts.sum())
    if not total:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    start = np.cumsum(counts) - counts
    short, _ = windows(h, np.array([0, len(h)]), anchor)  # those that two texts share are in no text's window
    low = _lowest(short, window - anchor + 1)[np.arange(total) + np.repeat(woff[:-1] - start, counts)]
    new = np.ones(total, bool)
    new[1:] = low[1:] != low[:-1]
    new[start[counts > 0]] = True
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [total]]) - 1
    doc = np.searchsorted(start + counts, first, "right")
    return low[first], doc, first - start[doc], last - start[doc]


def _key(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _written(df: DataFrame, name: str) -> DataFrame:
    """``materialize``; the shuffle files that went into the table go at once,
    not when the driver next collects its garbage."""
    with free_shuffles(df.sparkSession):
        return materialize(df, name)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _keyed(docs: DataFrame) -> DataFrame:
    return _read(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), _row().alias("row"), "text")


def _row() -> Column:
    """64 bits of a row's id and text: brings rows together, never tells them apart."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text")


#: Words a chunk, chunks a task and tasks, as powers of two: 63 bits together.
CHUNK, CHUNKS, TASKS = 16, 27, 20


def _bases(counts: np.ndarray, used: int, task: int) -> tuple[np.ndarray, int]:
    """Where the words of rows with ``counts`` words begin among all places,
    and the chunks used after them. A place is a number of its own for each
    word of each row; a row gets whole chunks, and as many empty ones before
    them, so that ``place - n`` is no other row's for any ``n`` up to its words."""
    size = (counts >> CHUNK) + 1
    after = used + np.cumsum(2 * size)
    end = int(after[-1]) if len(after) else used
    if end >= 1 << CHUNKS or task >= 1 << TASKS:
        raise OverflowError("more rows in a task, or tasks, than places are numbered for: use other partitions")
    return (np.int64(task) << (CHUNK + CHUNKS)) + ((after - size) << CHUNK), end


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _tag(digest: str) -> tuple[int, int]:
    """Tells the rows of one ``doc_id`` apart: 32 and 64 bits of the digest."""
    return int(digest[:8], 16) - (1 << 31), int(digest[8:24], 16) - (1 << 63)


def _tag_columns(whole: str) -> list[Column]:
    bits = lambda at, n: F.conv(F.substring(whole, at, n), 16, 10).cast("decimal(20, 0)")
    return [(bits(1, 8) - F.lit(1 << 31)).cast("int").alias("tag"),
            (bits(9, 16) - F.lit(Decimal(1 << 63)).cast("decimal(20, 0)")).cast("long").alias("more")]


def plain_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, id, row, n_words, whole)`` per row: its keys and the digest
    of all its words."""
    def work(batches):
        for batch in batches:
            texts = text_of(batch)
            for a, e in blocks(texts):
                words = [t.encode().split() for t in texts.slice(a, e - a).to_pylist()]
                ids = batch.column("doc_id").slice(a, e - a)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(_key(ids)), batch.column("row").slice(a, e - a), pa.array([len(w) for w in words], pa.int64()),
                     pa.array([_digest(w) for w in words], pa.string())], names=["doc_id", "id", "row", "n_words", "whole"])

    return _read(docs).withColumn("row", _row()).mapInArrow(
        work, "doc_id long, id long, row long, n_words long, whole string")


def _copies(plain: DataFrame, window: int) -> DataFrame:
    """``(id, row, whole)`` of the rows whose word sequence an earlier document has."""
    long = plain.where(F.col("n_words") >= window)
    first = long.groupBy("whole").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    return split_join(long, first, "whole").where("id > lo").select("id", "row", "whole").distinct()


def _first_of_each(*cols: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return new


def _seen(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(h, id, row)``: the anchors of each row. Of those that two ids of a
    block have, one row with the smallest and one with the largest keep
    their ``id``; it is null in the others, as these are known to repeat."""
    def anchors(batches):
        for batch in batches:
            texts = text_of(batch)
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
            for a, e in blocks(texts):
                b = Block(texts, a, e)
                b.split()
                h, doc, _, _ = _anchors(hash_spans(b.data, b.starts, b.ends), b.woff, window, anchor)
                if not len(h):
                    continue
                h, doc = signed(h), doc + a
                order = np.argsort(h)
                h, doc = h[order], doc[order]
                new = _first_of_each(h)
                alone = new & np.append(new[1:], True)
                more, i, key = h[~alone], ids[doc[~alone]], keys[doc[~alone]]
                order = np.lexsort((key, i, more))
                more, i, key = more[order], i[order], key[order]
                new = _first_of_each(more, i, key)
                more, i, key = more[new], i[new], key[new]
                known = np.zeros(len(more), bool)
                if len(more):
                    first = np.flatnonzero(_first_of_each(more))
                    last = np.append(first[1:], len(more)) - 1
                    known = np.repeat(i[first] < i[last], last - first + 1)
                    known[first] = known[last] = False
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([h[alone], more])),
                     pa.array(np.concatenate([ids[doc[alone]], i]), mask=np.concatenate([np.zeros(alone.sum(), bool), known])),
                     pa.array(np.concatenate([keys[doc[alone]], key]))], names=["h", "id", "row"])

    return _keyed(docs).select("id", "row", "text").mapInArrow(anchors, "h long, id long, row long")


def _by_run(batches, names: list[str]):
    """The columns of sorted rows as arrays, never cut within a run of the first."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [pc.fill_null(x, pa.scalar(0).cast(x.type)).to_numpy(zero_copy_only=False) for x in map(batch.column, names)]
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        other = np.flatnonzero(cols[0] != cols[0][-1])
        last = int(other[-1]) + 1 if len(other) else 0
        held = [c[last:] for c in cols]
        if last:
            yield [c[:last] for c in cols]
    if held is not None:
        yield held


def _least_and_most(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the smallest and largest id of its run of equal ``key``."""
    first = np.flatnonzero(_first_of_each(key))
    n = np.diff(np.append(first, len(key)))
    return np.repeat(np.minimum.reduceat(ids, first), n), np.repeat(np.maximum.reduceat(ids, first), n)


def _repeated(seen: DataFrame) -> DataFrame:
    """``(row, h)``: the anchors of ``(h, id, row)`` that two ids have. Equal
    ones meet in a task; those known to repeat (no id) go anywhere."""
    def twice(batches):
        for h, ids, row, known in _by_run(batches, ["h", "id", "row", "known"]):
            lo, hi = _least_and_most(h, ids)
            hot = (lo < hi) | known
            yield pa.RecordBatch.from_arrays([pa.array(row[hot]), pa.array(h[hot])], names=["row", "h"])

    return seen.repartition(F.when(F.col("id").isNull(), F.col("row")).otherwise(F.col("h"))).sortWithinPartitions("h") \
        .select("h", "id", "row", F.col("id").isNull().alias("known")).mapInArrow(twice, "row long, h long")


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _of_text(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One number for an anchor and its text. Should two pairs ever share one,
    some windows more are looked at, and none less."""
    return mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1)))


def candidates(docs: DataFrame, copies: DataFrame, window: int, anchor: int) -> DataFrame:
    """Level 0. ``(id, row, tag, more, base, last, pos, dig)`` of the texts that
    hold a repeated anchor: where the windows around those begin, and their
    digests; ``base`` and ``last`` are the places of the first word and of the
    last window."""
    hot = _written(_repeated(_seen(docs, window, anchor)).groupBy("row").agg(F.collect_set("h").alias("hot")),
                   "repeated-anchors")  # at most a row's own anchors
    gone = copies.groupBy("row").agg(F.collect_set("whole").alias("gone"))
    marked = hot.join(gone, "row", "left")

    def around(batches):
        task, used = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, hots, gones = text_of(batch), batch.column("hot"), batch.column("gone").to_pylist()
            for a, e in blocks(texts):
                b = Block(texts, a, e)
                b.split()
                words = hash_spans(b.data, b.starts, b.ends)
                h, doc, first, last = _anchors(words, b.woff, window, anchor)
                here = hots.slice(a, e - a)
                whose = np.repeat(np.arange(e - a), pc.list_value_length(here).to_numpy(zero_copy_only=False))
                mine = np.isin(_of_text(h, doc), _of_text(here.flatten().to_numpy(zero_copy_only=False).view(np.uint64), whose))
                tags, keep = [], []
                for i in np.unique(doc[mine]):
                    d = _digest(b.bytes_of(i).split())
                    if d not in (gones[a + i] or ()):
                        keep.append(i)
                        tags.append(_tag(d))
                if not keep:
                    continue
                keep = np.array(keep)
                mine &= np.isin(doc, keep)
                doc, first, n = doc[mine], first[mine], (last - first + 1)[mine]
                pos = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
                doc = np.repeat(doc, n)
                long, _ = windows(words, b.woff, window)
                room = np.maximum(np.diff(b.woff) - window + 1, 0)
                dig = signed(long)[(np.cumsum(room) - room)[doc] + pos]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=e - a)[keep])])
                base, used = _bases(np.diff(b.woff)[keep], used, task)
                rows = pa.array(keep + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("row").take(rows), pa.array([x for x, _ in tags], pa.int32()),
                     pa.array([x for _, x in tags], pa.int64()), pa.array(base), pa.array(base + pos[cuts[1:] - 1]),
                     _lists(pos, cuts, pa.int32()), _lists(dig, cuts, pa.int64())],
                    names=["id", "row", "tag", "more", "base", "last", "pos", "dig"])

    return split_join(_keyed(docs), marked, "row").mapInArrow(
        around, "id long, row long, tag int, more long, base long, last long, pos array<int>, dig array<long>")


#: Windows that are looked at together before they cross a shuffle, unless one row has more.
TOGETHER = 1 << 19


def _windows(found: DataFrame) -> DataFrame:
    """``(dig, id, base, place, hit)``, a row a window. ``hit`` is true where
    some rows of ``found`` looked at together show it, else null. Of a digest
    that repeats there, the smallest id's windows and one of the largest go
    on unknown."""
    def spread(batches):
        for batch in batches:
            n = pc.list_value_length(batch.column("dig")).to_numpy(zero_copy_only=False).astype(np.int64)
            end, a = np.cumsum(n), 0
            while a < batch.num_rows:
                e = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + TOGETHER, "right")))
                some = batch.slice(a, e - a)
                ids, base = (np.repeat(some.column(c).to_numpy(zero_copy_only=False), n[a:e]) for c in ("id", "base"))
                pos, dig = (some.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pos", "dig"))
                a = e
                if not len(dig):
                    continue
                order = np.lexsort((ids, dig))
                ids, base, pos, dig = ids[order], base[order], pos[order], dig[order]
                lo, _ = _least_and_most(dig, ids)
                hit = ids > lo
                hit[np.append(np.flatnonzero(_first_of_each(dig))[1:], len(dig)) - 1] = False
                yield pa.RecordBatch.from_arrays(
                    [pa.array(dig), pa.array(ids), pa.array(base), pa.array(base + pos), pa.array(hit, mask=~hit)],
                    names=["dig", "id", "base", "place", "hit"])

    return found.select("id", "base", "pos", "dig").mapInArrow(
        spread, "dig long, id long, base long, place long, hit boolean")


def _survivors(windows: DataFrame) -> DataFrame:
    """``(id, base, place, dig, hit)``: the windows whose digest two documents
    have; ``hit`` where one of them has a smaller id. Windows with equal
    digests meet in a task; known hits go anywhere."""
    def twice(batches):
        for dig, ids, base, place, hit in _by_run(batches, ["dig", "id", "base", "place", "hit"]):
            lo, hi = _least_and_most(dig, ids)
            on = (lo < hi) | hit
            yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (ids, base, place, dig, hit | (ids > lo))],
                                             names=["id", "base", "place", "dig", "hit"])

    return windows.repartition(F.when(F.col("hit"), F.col("base")).otherwise(F.col("dig"))).sortWithinPartitions("dig") \
        .mapInArrow(twice, "id long, base long, place long, dig long, hit boolean")


def _stretches(level: DataFrame) -> DataFrame:
    """``(id, base, place, n, same, dig, hit)``: the runs of ``n`` neighbouring
    windows of ``(id, base, place, dig, hit)``, with a digest ``same`` of all
    their words. Windows of two rows are never neighbours (see :func:`_bases`)."""
    names = ["id", "base", "place", "dig", "hit"]

    def cut(cols, cuts):
        i, base, place, dig, hit = cols
        first = cuts[:-1]
        same = [xxhash.xxh64_intdigest(dig[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(i[first]), pa.array(base[first]), pa.array(place[first]), pa.array(np.diff(cuts).astype(np.int32)),
             pa.array(signed(np.array(same, np.uint64))), _lists(dig, cuts, pa.int64()), _lists(hit, cuts, pa.bool_())],
            names=["id", "base", "place", "n", "same", "dig", "hit"])

    def runs(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cols[2]) != 1) + 1])
            held = [c[cuts[-1]:] for c in cols]
            if len(cuts) > 1:
                yield cut([c[:cuts[-1]] for c in cols], cuts)
        if held is not None:
            yield cut(held, np.array([0, len(held[0])]))

    return level.repartition("base").sortWithinPartitions("place").mapInArrow(
        runs, "id long, base long, place long, n int, same long, dig array<long>, hit array<boolean>")


_PAIRED = "kind long, place long, lo long, hi long, dig long"


def _paired(rows: list[np.ndarray], length: int) -> pa.RecordBatch:
    """Windows of ``2 * length`` words from two of ``length`` in one stretch;
    ``rows`` by place: stretch, place, lo, hi, digest."""
    kind, place, lo, hi, dig = rows
    tail = np.searchsorted(place, place + length)
    ok = tail < len(place)
    tail[~ok] = 0
    ok &= (place[tail] == place + length) & (kind[tail] == kind)
    tail = tail[ok]
    with np.errstate(over="ignore"):
        twice = signed(mix(mix(dig[ok].view(np.uint64) + np.uint64(length)) ^ (dig[tail].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (kind[ok], place[ok], lo[ok], hi[ok], twice)],
                                      names=["kind", "place", "lo", "hi", "dig"])


def _first_pairs(kinds: DataFrame, length: int) -> DataFrame:
    """The windows of twice the first length in the stretches ``(place, lo, hi, dig)``."""
    def pairs(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                digs = some.column("dig")
                n = pc.list_value_length(digs).to_numpy(zero_copy_only=False).astype(np.int64)
                kind, lo, hi = (np.repeat(some.column(c).to_numpy(zero_copy_only=False), n) for c in ("place", "lo", "hi"))
                place = kind + np.arange(len(kind)) - np.repeat(np.cumsum(n) - n, n)
                order = np.argsort(place, kind="stable")
                yield _paired([c[order] for c in (kind, place, lo, hi, digs.flatten().to_numpy(zero_copy_only=False))], length)

    return kinds.select("place", "lo", "hi", "dig").mapInArrow(pairs, _PAIRED)


def _next_pairs(level: DataFrame, length: int) -> DataFrame:
    """The windows of twice ``length`` words from the windows of ``level``."""
    names = ["kind", "place", "lo", "hi", "dig"]

    def pairs(batches):
        for cols in _by_run(batches, names):
            yield _paired(cols, length)

    return level.select(*names).repartition("kind").sortWithinPartitions("place").mapInArrow(pairs, _PAIRED)


def _shared(windows: DataFrame) -> DataFrame:
    """The rows of ``windows`` whose digest two stretches of different words
    and two documents have, with the smallest id as ``least``."""
    two = windows.groupBy("dig").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.min("kind").alias("a"), F.max("kind").alias("b")) \
        .where("least < most and a < b").select("dig", "least")
    return split_join(windows, two.hint("shuffle_hash"), "dig")


def levels(kinds: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(kind, at, length)``: the windows of twice, four times ... ``window``
    words that an earlier document has than any with the same stretch, by their
    place in the stretch. Each is made from two repeated halves; ends when no
    candidates survive. What documents with the same stretch have in common
    needs no search: all its windows, of all lengths."""
    out, length, twice = None, window, _first_pairs(kinds, window)
    while True:
        length *= 2
        level = _written(_shared(twice), "level")
        here = level.where("least < lo").select("kind", (F.col("place") - F.col("kind")).cast("int").alias("at"), F.lit(length).alias("length"))
        out = here if out is None else out.unionByName(here)
        if not level.take(1):
            return out
        twice = _next_pairs(level, length)


def _uncovered(hits: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(at, length) of the hits, by length in ``hits``, that no hit of the next
    level begins or ends with."""
    at, lengths = [], []
    for length, here in sorted(hits.items()):
        above = hits.get(2 * length)
        if above is not None:
            here = np.setdiff1d(here, np.concatenate([above, above + length]))
        at.append(here)
        lengths.append(np.full(len(here), length))
    return np.concatenate(at), np.concatenate(lengths)


_GONE = "id long, row long, tag int, more long, gone array<struct<at:int,n:int>>"


def _gone(batch: pa.RecordBatch, keep: np.ndarray, at: np.ndarray, n: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    here = pa.array(keep)
    spans = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (at, n)], names=["at", "n"])
    return pa.RecordBatch.from_arrays([batch.column(c).take(here) for c in ("id", "row", "tag", "more")]
                                      + [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans)],
                                      names=["id", "row", "tag", "more", "gone"])


def _all_spans(rows: DataFrame, window: int) -> DataFrame:
    """``gone`` of stretches all whose windows, of all lengths, are hits; ``at``
    is a stretch's first word. As :func:`_uncovered` gives: the longest that
    fit, and of half their length those between the first of these and the last."""
    def spans(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                some = batch.slice(a, 1024)
                words = some.column("n").to_numpy(zero_copy_only=False).astype(np.int64) + window - 1
                top = np.full(len(words), window)
                while (short := 2 * top <= words).any():
                    top = np.where(short, 2 * top, top)
                counts = np.maximum(words - top + 1, np.where(top > window, top // 2, 0))
                cuts = np.concatenate([[0], np.cumsum(counts)])
                at = np.arange(cuts[-1]) - np.repeat(cuts[:-1], counts)
                top_, room = np.repeat(top, counts), np.repeat(words - top, counts)
                begin = np.repeat(some.column("at").to_numpy(zero_copy_only=False).astype(np.int64), counts)
                yield _gone(some, np.arange(len(words)), begin + at, np.where(at <= room, top_, top_ // 2), cuts)

    return rows.select("id", "row", "tag", "more", "n", "at").mapInArrow(spans, _GONE)


def _spans(rows: DataFrame, window: int) -> DataFrame:
    """``gone`` of stretches of which only the windows that ``hit`` marks and
    those in ``longer`` are hits; ``at`` is a stretch's first word."""
    def spans(batches):
        for batch in batches:
            hit, longer = batch.column("hit"), batch.column("longer")
            begin = batch.column("at").to_numpy(zero_copy_only=False)
            marks = hit.flatten().to_numpy(zero_copy_only=False)
            to, far = (np.cumsum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)) for c in (hit, longer))
            flat = longer.flatten()
            off, length = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "length"))
            keep, ats, ns = [], [], []
            for i in range(batch.num_rows):
                x, y = (to[i - 1], far[i - 1]) if i else (0, 0)
                here = np.flatnonzero(marks[x:to[i]])
                if not len(here):
                    continue
                hits = {window: here}
                if far[i] > y:
                    mine = length[y:far[i]]
                    hits |= {int(z): off[y:far[i]][mine == z] for z in np.unique(mine)}
                at, n = _uncovered(hits)
                keep.append(i)
                ats.append(at + begin[i])
                ns.append(n)
            if keep:
                yield _gone(batch, np.array(keep), np.concatenate(ats), np.concatenate(ns),
                            np.concatenate([[0], np.cumsum([len(z) for z in ats])]))

    return rows.select("id", "row", "tag", "more", "at", "hit", "longer").mapInArrow(spans, _GONE)


def _hits(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(id, row, tag, more, longest, gone)``: from which words (``at``) how
    many (``n``) go from a row. Written, so that no window's shuffle is held
    while texts move."""
    found = _written(found, "candidates")  # places hold for one run of its tasks
    runs = _written(_stretches(_survivors(_windows(found))), "stretches")
    kinds = _written(runs.groupBy("same").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("place").alias("kind")), "kinds")
    one = _written(runs.select(F.col("place").alias("kind"), "dig").join(kinds, "kind")
                      .select(F.col("kind").alias("place"), "lo", "hi", "dig"), "one-each")  # one stretch of a kind
    longer = levels(one, window).groupBy("kind").agg(F.collect_list(F.struct("at", "length")).alias("longer"))  # at most a stretch's windows
    member = split_join(runs.drop("dig"), kinds.select("same", "lo", "kind"), "same") \
        .join(found.select("base", "row", "tag", "more"), "base").withColumn("at", (F.col("place") - F.col("base")).cast("int"))
    first = member.where("id = lo").join(longer, "kind", "left")
    gone = _spans(first, window).unionByName(_all_spans(member.where("id > lo"), window))
    return _written(gone.groupBy("id", "row", "tag", "more").agg(F.flatten(F.collect_list("gone")).alias("gone"))
                       .withColumn("longest", F.array_max(F.col("gone")["n"])), "hits")


def _cut(words: list[bytes], first: np.ndarray, n: np.ndarray) -> list[bytes]:
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, first.astype(np.int64), 1)
    np.add.at(edge, first.astype(np.int64) + n, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _removed(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``(id, whole, n_removed, kept_sha256, kept_text, longest)`` of the rows that lose
    words by hits."""
    def cut(batches):
        for batch in batches:
            rows = []
            tags = zip(batch.column("tag").to_pylist(), batch.column("more").to_pylist(), strict=True)
            for i, tag, t, gone, far in zip(batch.column("id").to_pylist(), tags, text_of(batch).to_pylist(),
                                            batch.column("gone"), batch.column("longest").to_pylist(), strict=True):
                words = t.encode().split()
                whole = _digest(words)
                if _tag(whole) == tag:
                    left = _cut(words, *(gone.values.field(c).to_numpy() for c in ("at", "n")))
                    rows.append((i, whole, len(words) - len(left), _digest(left), b" ".join(left).decode(), far))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["id", "whole", "n_removed", "kept_sha256", "kept_text", "longest"])

    return split_join(_keyed(docs), hits.drop("id"), "row").mapInArrow(
        cut, "id long, whole string, n_removed long, kept_sha256 string, kept_text string, longest int")


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, maximal: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept_text)`` per row of
    ``docs``: ``kept_text`` is the words left, joined by single spaces, or null
    where none was removed; ``kept_sha256`` the digest of the words left. ``maximal`` adds
    ``longest``, the longest level of a hit (0: none, or a copy of an earlier document)."""
    plain = _written(plain_rows(docs), "plain")
    copies = _written(_copies(plain, window), "copies")
    found = candidates(docs, copies, window, anchor)
    emptied = copies.select("id", "whole").distinct().select("id", "whole", F.lit(None).cast("long").alias("n_removed"),
                            F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit("").alias("kept_text"),
                            F.lit(None).cast("int").alias("longest"))
    changed = _removed(docs, _hits(found, window)).dropDuplicates(["id", "whole"]).unionByName(emptied)
    out = plain.join(changed, ["id", "whole"], "left")
    lost = F.col("kept_sha256").isNotNull()
    cols = ["doc_id", "n_words", F.when(lost, F.coalesce("n_removed", "n_words")).otherwise(F.lit(0)).alias("n_removed"),
            F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "kept_text"]
    if maximal:
        cols.append(F.coalesce("longest", F.lit(0)).alias("longest"))
    return out.select(*cols)


def drop_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with all its columns, ``text`` without the repeated words (the
    rest joined by single spaces, ``n_chars`` following, if there); texts that
    lose none stay as they are."""
    plain = _written(plain_rows(docs), "plain")
    copies = _written(_copies(plain, window), "copies")
    hits = _hits(candidates(docs, copies, window, anchor), window)
    copied = copies.select("row", *_tag_columns("whole"), F.lit(None).cast(hits.schema["gone"].dataType).alias("gone"))
    names = docs.columns
    marks = "marks" + "_" * max((len(n) for n in names), default=0)  # no column of docs is named so
    here = "row" + "_" * max((len(n) for n in names), default=0)
    found = hits.select("row", "tag", "more", "gone").unionByName(copied).groupBy("row") \
        .agg(F.collect_list(F.struct("tag", "more", "gone")).alias(marks)).withColumnRenamed("row", here)  # a row's own words

    def cut(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                some = batch.slice(a, 1024)
                old, marks_ = some.column("text").to_pylist(), some.column(marks)
                new = list(old)
                for i in np.flatnonzero(marks_.is_valid().to_numpy(zero_copy_only=False)):
                    words = (old[i] or "").encode().split()
                    tag = _tag(_digest(words))
                    for m in marks_[int(i)].as_py():
                        if (m["tag"], m["more"]) == tag:
                            new[i] = "" if m["gone"] is None else \
                                b" ".join(_cut(words, *(np.array([g[c] for g in m["gone"]]) for c in ("at", "n")))).decode()
                cols = {n: some.column(n) for n in names}
                cols["text"] = pa.array(new, cols["text"].type)
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([len(y) if y is not x else c for x, y, c in
                                                zip(old, new, cols["n_chars"].to_pylist(), strict=True)], cols["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    keyed = docs.withColumn(here, _row())
    return split_join(keyed, found, here, "left").drop(here).mapInArrow(cut, docs.schema)
