"""Language-model scores: a log-bilinear model trained by noise contrast.

Tokens (lower-case words and one end a text) fall into classes: each of the
``VOCABULARY`` most frequent training words is one, the end is one, and all
other words share ``SUFFIXES`` classes by their last letters. The log-bilinear
model predicts a token's class from the two before it: the context vectors
are added, and a class's score is their product with its vector plus its bias.
Noise-contrastive estimation trains it in numpy on every training document:
each input split trains from the same start, and the splits' parameters are
averaged by their tokens (a Spark sum of one row a parameter). Class
probabilities are normalised by batched matrix products over all contexts. A
word in a shared class then has its add-one share of the class's tokens.

Word counts cover the whole training corpus. The ``FREQUENT`` most frequent
words' counts travel to the scoring tasks (a fixed number); counts of the
others are joined to the tokens that need them.

Edge cases: a null or empty text is one end token; a null ``doc_id`` has
remainder 0 and trains; repeated rows come out once each; without training
documents all counts are zero; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.arrays import Block, blocks, hash_spans, mix, per_text, signed, text_of
from strata.session import materialize

#: Fixed by the contract.
FOLDS, HELD_OUT = 7, 2
VOCABULARY, SUFFIXES, FREQUENT = 512, 64, 1 << 17
DIM, NOISE, BATCH, RATE = 16, 32, 4096, 0.05
#: The end token's key among word keys (no word's: its suffix bits differ).
END = -1
HELD = 300_000
#: Training tokens a part.
PART = 1 << 22


def held_out(doc_ids: list) -> np.ndarray:
    return np.array([d is not None and zlib.crc32(str(d).encode()) % FOLDS == HELD_OUT for d in doc_ids], bool)


def word_keys(b: Block) -> np.ndarray:
    """A 64-bit key a word; its low six bits are the class of its last two
    bytes (63 is left to the end token)."""
    h = hash_spans(b.data, b.starts, b.ends)
    tail = b.data[b.ends - 1].astype(np.uint64)
    before = np.where(b.ends - b.starts > 1, b.data[np.maximum(b.ends - 2, 0)], 0).astype(np.uint64)
    suffix = mix(tail * np.uint64(257) + before) % np.uint64(SUFFIXES - 1)
    return signed((h & ~np.uint64(SUFFIXES - 1)) | suffix)


def _blocks(batch: pa.RecordBatch):
    texts = text_of(batch)
    for a, e in blocks(texts):
        b = Block(texts, a, e)
        b.lower()
        b.split()
        yield b, batch.column("doc_id").slice(a, e - a)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


# ------------------------------------------------------------------ counts

def count_words(docs: DataFrame) -> DataFrame:
    """``(w, c)``: how often each token occurs in the training documents."""
    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(inv, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["w", "c"])

    def work(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for b, ids in _blocks(batch):
                train = ~held_out(ids.to_pylist())
                keys = word_keys(b)[train[b.doc]]
                held.append((np.append(keys, END), np.append(np.ones(len(keys), np.int64), train.sum())))
                if sum(len(k) for k, _ in held) > 4 * HELD:
                    held = [merge(held)]
                    if len(held[0][0]) > HELD:
                        yield out(*held.pop())
        if held:
            yield out(*merge(held))

    return _read(docs).mapInArrow(work, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).where("c > 0")


# ------------------------------------------------------------------- model

@dataclass
class Classes:
    """Frequent words and what class each token has."""

    words: np.ndarray  # keys of the frequent words, sorted
    counts: np.ndarray
    label: np.ndarray  # class of each, or -1: by its suffix
    size: np.ndarray  # log10(tokens + types + 1) of each suffix class
    prior: np.ndarray  # share of training tokens by class
    tokens: int
    types: int

    @property
    def n(self) -> int:
        return VOCABULARY + SUFFIXES + 1  # the end is the last

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count or -1 if not among the frequent) of each word."""
        suffix = VOCABULARY + (keys & (SUFFIXES - 1))
        if not len(self.words):
            return suffix, np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        hit = self.words[at] == keys
        label = np.where(hit, self.label[at], -1)
        return np.where(label >= 0, label, suffix), np.where(hit, self.counts[at], -1)


def classes(counts: DataFrame) -> Classes:
    word = counts.where(F.col("w") != END)
    # the least count that at most FREQUENT words reach, by steps of about one part in 64: 4096 at most
    step = F.floor(F.log2("c") * 64).cast("int")
    least, room = 1 << 20, FREQUENT
    for r in sorted(word.groupBy(step.alias("s")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["s"]
    top = sorted(word.where(step >= least).collect(), key=lambda r: (-r["c"], r["w"]))  # at most FREQUENT
    words, n = np.array([r["w"] for r in top], np.int64), np.array([r["c"] for r in top], np.int64)
    label = np.where(np.arange(len(top)) < VOCABULARY, np.arange(len(top)), -1)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"),
                       F.coalesce(F.sum(F.when(F.col("w") == END, F.col("c"))), F.lit(0)).alias("end")).first()
    by = np.zeros((SUFFIXES, 2))
    for r in counts.where(F.col("w") != END).groupBy((F.col("w").bitwiseAND(SUFFIXES - 1)).alias("k")) \
            .agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        by[r["k"]] = r["n"], r["v"]
    for w, c in zip(words[:VOCABULARY], n[:VOCABULARY], strict=True):  # classes of their own
        by[w & (SUFFIXES - 1)] -= c, 1
    prior = np.concatenate([np.pad(n[:VOCABULARY], (0, VOCABULARY - min(len(n), VOCABULARY))), by[:, 0], [total["end"]]]) + 0.5
    order = np.argsort(words)
    return Classes(words[order], n[order], label[order], np.log10(by.sum(1) + 1), prior / prior.sum(),
                   int(total["n"]), int(total["v"]))


def contexts(c: np.ndarray, woff: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Tokens of all texts with their ends: (class, the one before, the one
    before that, text). ``n`` stands for what is before a text."""
    counts = np.diff(woff)
    size = counts + 1
    doc = np.repeat(np.arange(len(counts)), size)
    at = np.cumsum(size) - 1
    target = np.empty(int(size.sum()), np.int64)
    is_end = np.zeros(len(target), bool)
    is_end[at] = True
    target[is_end] = n - 1
    target[~is_end] = c
    one, two = np.full(len(target), n), np.full(len(target), n)
    one[1:] = np.where(doc[1:] == doc[:-1], target[:-1], n)
    two[2:] = np.where(doc[2:] == doc[:-2], target[:-2], n)
    return target, one, two, doc


class Model:
    """Context vectors for both places, class vectors, biases."""

    def __init__(self, n: int, prior: np.ndarray, flat: np.ndarray | None = None):
        self.n = n
        self.shapes = [(n + 1, DIM), (n + 1, DIM), (n, DIM), (n,)]
        if flat is None:
            rng = np.random.default_rng(7)
            self.p = [rng.normal(0, 0.1, s).astype(np.float32) for s in self.shapes[:3]] + [np.log(prior).astype(np.float32)]
        else:
            cut = np.cumsum([int(np.prod(s)) for s in self.shapes])[:-1]
            self.p = [x.reshape(s).astype(np.float32) for x, s in zip(np.split(flat, cut), self.shapes, strict=True)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p]).astype(np.float64)

    def log_z(self) -> np.ndarray:
        """Log normaliser of every context (one before, the one before that)."""
        r1, r2, q, b = self.p
        out = np.empty((self.n + 1, self.n + 1), np.float32)
        for i in range(self.n + 1):
            s = (r1[i] + r2) @ q.T + b
            m = s.max(1)
            out[i] = m + np.log(np.exp(s - m[:, None]).sum(1))
        return out

    def log_probabilities(self, t: np.ndarray, one: np.ndarray, two: np.ndarray, log_z: np.ndarray) -> np.ndarray:
        r1, r2, q, b = self.p
        return np.einsum("ij,ij->i", r1[one] + r2[two], q[t]) + b[t] - log_z[one, two]


class Trainer:
    """NCE steps with AdaGrad; a batch shares its noise."""

    def __init__(self, model: Model, prior: np.ndarray):
        self.m = model
        self.g2 = [np.full(s, 0.01, np.float32) for s in model.shapes]
        self.log_noise = np.log(NOISE * prior).astype(np.float32)
        self.prior, self.rng = prior, np.random.default_rng(11)

    def step(self, t: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        r1, r2, q, b = self.m.p
        n, size = self.m.n, len(t)
        ctx = r1[one] + r2[two]
        noise = self.rng.choice(n, NOISE, p=self.prior)
        own = np.einsum("ij,ij->i", ctx, q[t]) + b[t] - self.log_noise[t]
        e_own = 1 / (1 + np.exp(np.clip(own, -30, 30)))  # 1 - sigmoid
        other = ctx @ q[noise].T + (b - self.log_noise)[noise]
        e_other = -1 / (1 + np.exp(-np.clip(other, -30, 30)))
        d_ctx = e_own[:, None] * q[t] + e_other @ q[noise]
        grads = [_scatter(one, d_ctx, n + 1), _scatter(two, d_ctx, n + 1), _scatter(t, e_own[:, None] * ctx, n),
                 np.bincount(t, e_own, n).astype(np.float32)]
        np.add.at(grads[2], noise, e_other.T @ ctx)
        np.add.at(grads[3], noise, e_other.sum(0))
        for x, g, g2 in zip(self.m.p, grads, self.g2, strict=True):
            g /= size
            g2 += g * g * 100
            x += RATE * 10 * g / np.sqrt(g2)


def _scatter(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    order = np.argsort(index, kind="stable")
    s = index[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[s[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def dealt(docs: DataFrame, tokens: int) -> DataFrame:
    """``docs`` in parts of about ``PART`` training tokens, by a hash of id and
    text and in an order of their own: the same rows give the same parts
    however they were split before, and parts grow in number with the rows."""
    h = F.xxhash64("doc_id", "text")
    return _read(docs).repartition(max(1, -(-tokens // PART)), h).sortWithinPartitions(h, "doc_id", "text")


def train(docs: DataFrame, cls: Classes, rounds: int = 1) -> Model:
    model, docs = Model(cls.n, cls.prior), dealt(docs, cls.tokens)
    for _ in range(rounds):
        start = model.flat()

        def work(batches, start=start):
            trainer = Trainer(Model(cls.n, cls.prior, start), cls.prior)
            seen = 0
            for batch in batches:
                for b, ids in _blocks(batch):
                    train_ = ~held_out(ids.to_pylist())
                    t, one, two, doc = contexts(cls.of(word_keys(b))[0], b.woff, cls.n)
                    use = np.flatnonzero(train_[doc])
                    use = use[np.argsort(mix(use.astype(np.uint64)))]  # mixed, and alike on every try
                    for a in range(0, len(use), BATCH):
                        i = use[a:a + BATCH]
                        trainer.step(t[i], one[i], two[i])
                    seen += len(use)
            if seen:
                p = trainer.m.flat() * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(p) + 1)), pa.array(np.append(p, seen))],
                                                 names=["i", "v"])

        rows = docs.mapInArrow(work, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        if not rows:
            break
        flat = np.zeros(len(start) + 1)
        for r in rows:  # one row a parameter
            flat[r["i"]] = r["v"]
        model = Model(cls.n, cls.prior, flat[:-1] / flat[-1])
    return model


# ------------------------------------------------------------------- score

def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score)``; scores are log10 probabilities of whole texts."""
    counts = materialize(count_words(docs), "word-counts")
    cls = classes(counts)
    model = train(docs, cls)
    log_z = model.log_z()
    unit = np.log10(np.e)
    end = counts.where(F.col("w") == END).first()
    end_count = end["c"] if end else 0

    def work(batches):
        for batch in batches:
            for b, ids in _blocks(batch):
                keys = word_keys(b)
                c, n = cls.of(keys)
                t, one, two, doc = contexts(c, b.woff, cls.n)
                lm = np.bincount(doc, model.log_probabilities(t, one, two, log_z).astype(np.float64), b.n) * unit
                shared = (c >= VOCABULARY) & (c < VOCABULARY + SUFFIXES)
                seen = np.log10(np.maximum(n, 0) + 1.0)
                lm += per_text(np.where(shared, seen - cls.size[np.clip(c - VOCABULARY, 0, SUFFIXES - 1)], 0), b.woff)
                base = per_text(seen, b.woff) + np.log10(end_count + 1)
                known = per_text(n > 0, b.woff) + (end_count > 0)
                tag = pa.array([xxhash.xxh3_128_digest(b.bytes_of(i)) for i in range(b.n)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids, tag, pa.nulls(b.n, pa.int64()), pa.array(np.diff(b.woff) + 1), pa.array(known),
                     pa.array(base), pa.array(lm)], names=names)
                rare = np.flatnonzero(n < 0)
                if len(rare):
                    d, w = b.doc[rare], keys[rare]
                    order = np.lexsort((w, d))
                    d, w = d[order], w[order]
                    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])]))
                    many = np.diff(np.append(first, len(d)))
                    d, w = d[first], w[first]
                    k = len(d)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(d)), tag.take(pa.array(d)), pa.array(w), pa.array(many), pa.nulls(k, pa.int64()),
                         pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())], names=names)

    names = ["doc_id", "tag", "w", "n", "known", "base", "lm"]
    parts = materialize(_read(docs).mapInArrow(work, "doc_id long, tag binary, w long, n long, known long, base double, lm double"),
                        "score-parts")
    whole = parts.where("w is null").groupBy("doc_id", "tag").agg(
        F.count("*").alias("copies"), F.first("n").alias("n"), F.first("known").alias("known"), F.first("base").alias("base"),
        F.first("lm").alias("lm"))
    rare = parts.where("w is not null").select("doc_id", "tag", "w", "n").join(counts, "w").groupBy("doc_id", "tag").agg(
        F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("add")) \
        .withColumnsRenamed({"doc_id": "d", "tag": "g"})
    each = whole.join(rare, whole["doc_id"].eqNullSafe(rare["d"]) & (whole["tag"] == rare["g"]), "left")
    copies = F.col("copies")
    more, add = F.coalesce("more", F.lit(0)) / copies, F.coalesce("add", F.lit(0.0)) / copies
    size = float(np.log10(cls.tokens + cls.types + 1))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return each.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(
        "doc_id", held.alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + more).cast("long").alias("n_known"),
        F.lit(cls.tokens).cast("long").alias("train_tokens"), (F.col("base") + add - F.col("n") * size).alias("base_score"),
        (F.col("lm") + add).alias("score"))
