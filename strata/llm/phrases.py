"""Collocations by multikey three-way quicksort of suffix pointers.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
those at spaces and tabs into words; everything is per language (null:
``und``). A suffix pointer stands for the up to ``DEPTH`` words that follow a
place. Three passes:

1. ``vocabulary``: exact counts of all words, and the two- and three-word
   starts that hold at least ``HOT`` of all words' share of some block.
2. ``route``: pointers go to the partition of their two leading words. A start
   that holds more than ``HOT`` of all words is routed by the next word too
   (and a three-word start by all four), so no partition holds a hot one whole.
   A pointer ends before a word that is rarer than ``least``: no phrase with it
   can count. Equal pointers of a block travel once, with their number. The
   ``FREQUENT`` most frequent words travel as numbers that all workers know,
   others with the part of a block that goes to a partition. Parts are packed
   and unpacked in array steps, many to a step: their number grows with blocks
   times partitions, which is faster than the corpus.
3. ``sort``: each partition's pointers are three-way partitioned word by word
   to full depth, all segments of a round at once. The size of an equal
   partition is the phrase's count; segments lighter than ``least`` are
   abandoned, but for those with a hot start, whose parts are added up after.

The workers hold one partition's pointers at a time, about ``POINTERS``, a
number of partitions that grows with the corpus keeps them so; what is
broadcast is a bitmap of frequent words of a fixed size, ``FREQUENT`` words
and at most 4 / HOT hot starts.

Edge cases: null, empty and blank texts have no words; rows count as often as
they occur, ids do not matter; a null language and ``und`` are one; very long
texts are read whole; ties rank by their count, then by the phrase's bytes;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.arrays import Block, blocks, mix, offsets, runs, signed, text_of
from strata.llm.tokens import bitmap, hashes, may_hold, numbered
from strata.session import materialize

LEAST, COVER, TOP, DEPTH = 30, 80, 2000, 4
HOT = 1 / 2048
POINTERS = 1 << 20
BITS = 24
FREQUENT = 1 << 17
PARTS = 64
BLOCK = 1 << 23
BATCH = 1 << 26

#: Fixed by the contract: what ends a piece, and what ends a word inside one.
_CUT, _WORD = np.zeros(256, bool), np.ones(256, bool)
_CUT[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD[[0x20, 0x09]] = False
_WORD &= ~_CUT


class Words:
    """A block's words: ``number`` (from 1) into ``words``, ``lang`` into
    ``langs``, and ``joined``: the next word follows in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array, a: int, b: int):
        block = Block(texts, a, b)
        block.lower()
        starts, ends = runs(_WORD[block.data], block.off)
        edge = np.searchsorted(starts, block.off)
        doc = np.repeat(np.arange(block.n), np.diff(edge))
        coded = pc.fill_null(langs.slice(a, b - a).cast(pa.large_string()), "und").dictionary_encode()
        self.langs = coded.dictionary
        self.lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        number, self.words = numbered(block.data, starts, ends)
        self.number = number + 1
        cuts = np.cumsum(_CUT[block.data], dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int64)
        self.joined = np.zeros(len(starts), bool)
        self.joined[:-1] = (doc[1:] == doc[:-1]) & (cuts[1:] == cuts[:-1])
        self.base = len(self.words) + 1
        self.word_hash = np.concatenate([[np.uint64(0)], hashes(self.words)])
        self.lang_hash = hashes(self.langs, 1)

    def hash(self, lang: np.ndarray, *columns: np.ndarray) -> np.ndarray:
        h = self.lang_hash[lang]
        for c in columns:
            h = mix(h ^ self.word_hash[c])
        return h


def _text(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """The words of ``columns`` (numbers from 1) joined by a space, by row."""
    parts = [words.take(pa.array(c - 1)).cast(pa.large_string()) for c in columns]
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if len(parts) > 1 else parts[0]


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(lang, phrase, depth, h, c)``: all words with depth 1, and starts
    that are frequent in a block, counted there, with depths 2 and 3."""

    def rows(w: Words):
        level = w.lang * w.base + w.number
        share = max(2.0, HOT / 2 * len(level))
        if len(w.langs) * w.base <= 4 * len(level):
            every = np.bincount(level)
            key = np.flatnonzero(every)
            c, heavy = every[key], every[level] >= share
        else:
            key, back, c = np.unique(level, return_inverse=True, return_counts=True)
            heavy = c[back] >= share
        yield 1, key // w.base, [key % w.base], c
        at = np.flatnonzero(heavy)  # a start is at most as frequent as each of its words
        for depth in (2, 3):
            at = at[w.joined[at + depth - 2]]
            at = at[heavy[at + depth - 1]]
            if not len(at):
                return
            key = level[at] * w.base + w.number[at + depth - 1]
            _, first, back, c = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            enough = c >= share
            some = at[first[enough]]
            yield depth, w.lang[some], [w.number[some + k] for k in range(depth)], c[enough]
            keep = enough[back]
            at, back = at[keep], back[keep]
            level[at] = back

    def work(batches):
        for batch in batches:
            texts = text_of(batch)
            for a, b in blocks(texts, BLOCK):
                w = Words(texts, batch.column("lang"), a, b)
                for depth, lang, columns, c in rows(w):
                    h = w.hash(lang, *columns) if depth == 1 else np.zeros(len(lang), np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [w.langs.take(pa.array(lang)).cast(pa.string()), _text(w.words, columns).cast(pa.string()),
                         pa.array(np.full(len(lang), depth, np.int32)), pa.array(signed(h)), pa.array(c.astype(np.int64))],
                        names=["lang", "phrase", "depth", "h", "c"])

    return docs.select("lang", "text").mapInArrow(work, "lang string, phrase string, depth int, h long, c long") \
        .groupBy("lang", "phrase", "depth").agg(F.first("h").alias("h"), F.sum("c").alias("c"))


def _hot(keys: list[tuple], langs: pa.Array, words: pa.Array, lang: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Which rows of ``columns`` are one of ``keys`` (lang, word, word ..)."""
    out = np.zeros(len(lang), bool)
    if not keys or not len(lang):
        return out
    at_lang = {v: i for i, v in enumerate(langs.to_pylist())}
    used = pa.array(sorted({x for k in keys for x in k[1:]}), pa.large_string())
    found = pc.index_in(used, value_set=words.cast(pa.large_string())).to_pylist()
    number = {v: i + 1 for v, i in zip(used.to_pylist(), found, strict=True) if i is not None}
    base = len(words) + 1
    codes = []
    for k in keys:
        if k[0] in at_lang and all(x in number for x in k[1:]):
            codes.append(tuple([at_lang[k[0]], *(number[x] for x in k[1:])]))
    if not codes:
        return out
    want = np.array(codes, np.int64)
    live = np.flatnonzero(np.isin(lang * base + columns[0], want[:, 0] * base + want[:, 1]))
    for d in range(2, want.shape[1]):  # two columns at a time keep the keys within 64 bits
        code = columns[d - 2][live].astype(np.int64) * base + columns[d - 1][live]
        live = live[np.isin(code, want[:, d - 1] * base + want[:, d])]
    keys = set(codes)
    for i in live:
        out[i] = (int(lang[i]), *(int(c[i]) for c in columns)) in keys
    return out


def common_words(often: DataFrame) -> pa.Array:
    """The words of ``often`` that are most frequent in some language, at most
    ``FREQUENT``, the most frequent first."""
    step = F.floor(F.log2("c") * 64).cast("int")  # of about one part in 64: 4096 at most
    least, room = 1 << 20, FREQUENT
    for r in sorted(often.groupBy(step.alias("s")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["s"]
    top = sorted(often.where(step >= least).select("phrase", "c").collect(), key=lambda r: (-r["c"], r["phrase"]))  # at most FREQUENT
    return pa.array(list(dict.fromkeys(r["phrase"] for r in top)), pa.large_string())


def route(docs: DataFrame, frequent: np.ndarray, hot: dict[int, list[tuple]], common: pa.Array, partitions: int) -> DataFrame:
    """``(p, lang, numbers, far, weights, heavy, words)``: a block's pointers
    of one language for one partition, packed by ``_pack``."""

    def pointers(w: Words):
        n = len(w.number)
        fine = may_hold(frequent, w.hash(w.lang, w.number)) if n else np.zeros(0, bool)
        follow = np.zeros(n, bool)
        follow[:-1] = w.joined[:-1] & fine[1:]
        at = np.flatnonzero(fine & follow)
        cols, live = [w.number[at]], np.ones(len(at), bool)
        for d in range(1, DEPTH):
            live = live & follow[np.minimum(at + d - 1, n - 1)]
            cols.append(np.where(live, w.number[np.minimum(at + d, n - 1)], 0))
        return w.lang[at], cols

    def work(batches):
        for batch in batches:
            texts = text_of(batch)
            for a, b in blocks(texts, BLOCK):
                w = Words(texts, batch.column("lang"), a, b)
                lang, cols = pointers(w)
                if not len(lang):
                    continue
                front, back = (lang * w.base + cols[0]) * w.base + cols[1], cols[2] * w.base + cols[3]
                order = np.lexsort((back, front))
                front, back = front[order], back[order]
                new = np.ones(len(order), bool)
                new[1:] = (front[1:] != front[:-1]) | (back[1:] != back[:-1])
                first = np.flatnonzero(new)
                weight = np.diff(np.append(first, len(order)))
                at = order[first]
                lang, cols = lang[at], [c[at] for c in cols]
                h = w.hash(lang, *cols[:2])
                for d in (2, 3):
                    more = np.flatnonzero(_hot(hot[d], w.langs, w.words, lang, cols[:d]))
                    h[more] = mix(h[more] ^ w.word_hash[cols[d][more]] ^ np.uint64(d))
                p = (h % np.uint64(partitions)).astype(np.int64)
                group = p * len(w.langs) + lang
                order = np.argsort(group, kind="stable")
                group = group[order]
                edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                at = order[edges]
                packed = _pack(w.words, common, np.stack(cols, axis=1)[order], weight[order], edges)
                whole = [pa.array(p[at].astype(np.int32)), w.langs.take(pa.array(lang[at])).cast(pa.string()), *packed]
                for i, j in blocks(packed[0], BATCH):
                    yield pa.RecordBatch.from_arrays(
                        [c.slice(i, j - i).cast(pa.binary()) if pa.types.is_large_binary(c.type) else c.slice(i, j - i) for c in whole],
                        names=["p", "lang", "numbers", "far", "weights", "heavy", "words"])

    out = docs.select("lang", "text").mapInArrow(
        work, "p int, lang string, numbers binary, far binary, weights binary, heavy binary, words binary")
    return out.repartitionById(partitions, "p")


def _joined(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between consecutive ``edges``."""
    off = (edges * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(values))])


def _parted(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(what ``_joined`` put into ``column``, end to end; how much in each row)"""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    data = column.buffers()[2]
    values = np.frombuffer(data, kind, (off[-1] - off[0]) // size, off[0]) if off[-1] > off[0] else np.zeros(0, kind)
    return values, np.diff(off) // size


def _narrow(values: np.ndarray, edges: np.ndarray, kind: str) -> tuple[pa.Array, pa.Array]:
    """``_joined`` as ``kind``, whose largest value stands for those that are
    too large for it; these, whole."""
    top = np.iinfo(kind).max
    far = values >= top
    among = np.concatenate([[0], np.cumsum(far)])
    return _joined(np.where(far, top, values).astype(kind), edges), _joined(values[far].astype("<i4"), among[edges])


def _wide(near: pa.Array, far: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    values, n = _parted(near, kind)
    out = values.astype(np.int32)
    out[values == np.iinfo(kind).max] = _parted(far, "<i4")[0]
    return out, n


def _pack(words: pa.Array, common: pa.Array, rows: np.ndarray, weight: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Pointers (``rows`` of numbers of ``words``), a row for each stretch that
    begins at ``first``: their words as numbers, 0 for none, from 1 those of
    ``common``, then those of the stretch's own words, each ended by a space."""
    base, edges = len(words) + 1, np.append(first, len(rows))
    known = pc.fill_null(pc.index_in(words, value_set=common), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    table = np.concatenate([[0], np.where(known >= 0, known + 1, len(common) + 1)])
    local, number = rows.ravel(), table[rows].ravel()
    at = np.flatnonzero(number > len(common))
    of = np.searchsorted(edges * DEPTH, at, "right") - 1
    used, place = np.unique(of * base + local[at], return_inverse=True)
    begin = np.searchsorted(used, np.arange(len(edges)) * base)
    number[at] += place - begin[of]
    empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    own = pc.binary_join_element_wise(words.take(pa.array(used % base - 1)).cast(pa.large_string()), empty, space)
    off = offsets(own)
    data = np.frombuffer(own.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    return [*_narrow(number, edges * DEPTH, "<u2"), *_narrow(weight, edges, "u1"), _joined(data, off[begin] - off[0])]


def _unpack(batches: list[pa.RecordBatch], common: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(``common`` and the other words, pointers as columns of numbers from 1
    of them, weights)"""
    numbers, weights, texts, seen = [], [], [], 0
    for batch in batches:
        number, n = _wide(batch.column("numbers"), batch.column("far"), "<u2")
        text, size = _parted(batch.column("words"), "u1")
        ends = np.concatenate([[0], np.cumsum(text == 0x20)])
        begin = seen + ends[np.cumsum(size) - size]
        at = np.flatnonzero(number > len(common))
        number[at] += begin[np.searchsorted(np.cumsum(n), at, "right")].astype(np.int32)
        seen += int(ends[-1])
        numbers.append(number)
        weights.append(_wide(batch.column("weights"), batch.column("heavy"), "u1")[0])
        texts.append(text)
    number, text = np.concatenate(numbers), np.concatenate(texts)
    ends = np.flatnonzero(text == 0x20)
    index, own = numbered(text, np.concatenate([[0], ends[:-1] + 1])[:len(ends)], ends)
    at = np.flatnonzero(number > len(common))
    number[at] = len(common) + 1 + index[number[at] - len(common) - 1]
    return pa.concat_arrays([common, own]), np.ascontiguousarray(number.reshape(-1, DEPTH).T), np.concatenate(weights).astype(np.int64)


def three_way(key: np.ndarray, rows: np.ndarray, lens: np.ndarray, weight: np.ndarray,
              kept: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts each segment of ``rows`` (of ``lens`` rows each) by ``key``: rows
    smaller than, equal to and greater than a pivot, round by round, all
    segments at once. Returns the equal partitions in the same form. A segment
    that weighs under ``least`` and has no row in ``kept`` is abandoned."""
    done_rows, done_lens = [rows[:0]], [lens[:0]]
    while len(lens):
        starts = np.cumsum(lens) - lens
        use = np.add.reduceat(weight[rows], starts) >= least
        if kept is not None:
            use |= np.logical_or.reduceat(kept[rows], starts)
        if not use.all():
            rows, lens = rows[np.repeat(use, lens)], lens[use]
            if not len(lens):
                break
            starts = np.cumsum(lens) - lens
        k = key[rows]
        pivot = np.sort(np.stack([k[starts], k[starts + lens // 2], k[starts + lens - 1]]), axis=0)[1]
        seg, pivot = np.repeat(np.arange(len(lens)), lens), np.repeat(pivot, lens)
        same, less = k == pivot, k < pivot
        more = ~(same | less)
        n_same, n_less, n_more = (np.bincount(seg[x], minlength=len(lens)) for x in (same, less, more))
        done_rows.append(rows[same])
        done_lens.append(n_same)
        rows = np.concatenate([rows[less], rows[more]])
        lens = np.concatenate([n_less[n_less > 0], n_more[n_more > 0]])
    return np.concatenate(done_rows), np.concatenate(done_lens)


def sort(routed: DataFrame, hot: dict[int, list[tuple]], common: pa.Array, least: int) -> DataFrame:
    """``(lang, phrase, depth, c)``: counts of the phrases of 2 to ``DEPTH``
    words; those of hot starts are of one partition only."""

    def work(batches):
        batches = [batch for batch in batches if batch.num_rows]
        if not batches:
            return
        coded = pa.chunked_array([batch.column("lang") for batch in batches]).combine_chunks().dictionary_encode()
        n = np.concatenate([_parted(batch.column("weights"), "u1")[1] for batch in batches])
        langs, code = coded.dictionary, np.repeat(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), n)
        words, cols, weight = _unpack(batches, common)
        batches.clear()
        flags = {d: _hot(hot[d], langs, words, code, list(cols[:d])) for d in (2, 3)}
        flags = {d: f if f.any() else None for d, f in (flags | {1: flags[2]}).items()}
        rows, lens = np.argsort(code, kind="stable"), np.bincount(code)
        for d in range(1, DEPTH + 1):
            kept = flags.get(d)
            rows, lens = three_way(cols[d - 1], rows, lens, weight, kept, least)
            if not len(lens):
                break
            starts = np.cumsum(lens) - lens
            mass = np.add.reduceat(weight[rows], starts)
            use = mass >= least
            if kept is not None:
                use |= np.logical_or.reduceat(kept[rows], starts)
            use &= cols[d - 1][rows[starts]] > 0
            first, mass = rows[starts[use]], mass[use]
            rows, lens = rows[np.repeat(use, lens)], lens[use]
            if d > 1 and len(first):
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(code[first])).cast(pa.string()), _text(words, [c[first] for c in cols[:d]]).cast(pa.string()),
                     pa.array(np.full(len(first), d, np.int32)), pa.array(mass)], names=["lang", "phrase", "depth", "c"])

    return routed.mapInArrow(work, "lang string, phrase string, depth int, c long")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, depth, f)`` of all phrases of 1 to ``DEPTH`` words
    that occur ``least`` times or more, and ``(lang, n)``."""
    seen = materialize(vocabulary(docs), "vocabulary")
    words = seen.where("depth = 1")
    sizes = materialize(words.groupBy("lang").agg(F.sum("c").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot: dict[int, list[tuple]] = {2: [], 3: []}
    for r in seen.where((F.col("depth") > 1) & (F.col("c") >= HOT / 2 * total)).collect():  # at most 4 / HOT rows
        hot[r["depth"]].append((r["lang"], *r["phrase"].split(" ")))
    often = words.where(F.col("c") >= least)
    frequent, common = bitmap(often, "h", BITS), common_words(often)
    partitions = max(1, -(-total // POINTERS))
    found = sort(route(docs, frequent, hot, common, partitions), hot, common, least) \
        .groupBy("lang", "phrase", "depth").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    return materialize(found.union(often.select("lang", "phrase", "depth", F.col("c").alias("f"))), "phrases"), sizes


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top``
    phrases by their lowest-scoring cut."""
    counts, sizes = phrase_counts(docs, least)
    part = lambda a, n: F.array_join(F.slice(F.col("ws"), a, n), " ")
    long = counts.where("depth > 1").select("lang", "phrase", "depth", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))
    cuts = long.select("lang", "phrase", "depth", "a", "ws", F.explode(F.expr("sequence(1, depth - 1)")).alias("k")) \
        .select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"),
                part(F.col("k") + 1, F.col("depth") - F.col("k")).alias("right"))
    f = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    g = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    cuts = cuts.join(f, ["lang", "left"]).join(g, ["lang", "right"]).select(
        "lang", "phrase", "a", F.struct(
            F.expr(f"cast(cast(2000000 as decimal(8, 0)) * {wide('a')} div ({wide('l')} + {wide('r')}) as long)").alias("score"),
            "k", "l", "r").alias("cut"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    spans = [(i, n) for n in range(2, DEPTH) for i in range(1, DEPTH - n + 2)]
    inner = long.where("depth > 2").select("lang", F.col("a").alias("f"), F.explode(F.array_distinct(F.filter(F.array(*[
        F.when(F.col("depth") >= F.greatest(F.lit(i + n - 1), F.lit(n + 1)), part(F.lit(i), F.lit(n))) for i, n in spans]),
        lambda x: x.isNotNull()))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | F.expr(f"100 * {wide('longer')} < {cover} * {wide('a')}"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    # a language's best are among the best of its parts, which are of bounded size
    salt = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = Window.partitionBy("lang", salt).orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= top)
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        "n", F.col("cut.score").alias("score"))
