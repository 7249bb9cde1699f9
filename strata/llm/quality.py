"""Quality rules and a hashed n-gram logistic regression.

The rules count (:func:`rule_counts`). The classifier sees, of each whole
text, which hashed features occur: lower-case words, pairs of neighbouring
words, and character n-grams of four, six and eight bytes, each a 64-bit hash
(wide enough that very long texts do not light up a feature by collision),
with the logarithm of how often. It is trained on a
bounded, stratified sample of the labelled rows (``per_cell`` a combination of
labels, smallest hash of ``doc_id`` first): the ``features`` features that
separate the labels best get weights, by gradient descent with an L2 penalty;
a held-out third of the sample fits a Platt scaling, weighted back to the
labels' true shares. Scoring is a lookup in Arrow batches; a text is rejected
when a head's probability passes its fixed threshold.

Edge cases: a null text has no words and fails the rules; a null ``doc_id``
scores like any other; repeated rows come out once each; labels with nulls are
left out of the sample; without labelled rows of both kinds a head rejects
nothing; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.arrays import Block, blocks, hash_spans, mix, per_text, runs, text_of, windows
from strata.session import materialize

#: Fixed by the contract.
MIN_WORDS, MAX_REPEAT_PCT, REPEAT_WINDOW, SYMBOLS = 10, 20, 5, b"#*$%&|<>"
PER_CELL, FEATURES, MIN_SUPPORT = 1000, 256, 8
#: Bytes in a character n-gram.
GRAMS = (4, 6, 8)
#: Bytes of text whose features are held at once (a longer text is whole).
HELD = 1 << 19
THRESHOLDS = {"low_quality": 0.5, "toxic": 0.5}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_W, _B, _C = (np.uint64(x) for x in (0x51, 0xB2, 0xC4))


# ------------------------------------------------------------------- rules

def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.zeros(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def rule_counts(b: Block) -> dict[str, np.ndarray]:
    """Per text of a split block: n_words, word_chars, n_symbols, n_dup_lines
    and n_repeat_words."""
    woff = b.woff
    out = {"n_words": np.diff(woff)}
    out["word_chars"] = per_text(((b.data & 0xC0) != 0x80) & b.word, b.off)
    out["n_symbols"] = per_text(_SYMBOL[b.data], b.off)
    # lines with a word, equal to an earlier one of the text
    starts, ends = runs(b.data != 0x0A, b.off)
    words = np.searchsorted(b.starts, ends) - np.searchsorted(b.starts, starts)
    starts, ends = starts[words > 0], ends[words > 0]
    doc = np.searchsorted(b.off, starts, "right") - 1
    key = hash_spans(b.data, starts, ends) ^ mix(doc.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), np.int64)
    again[first] = 0
    out["n_dup_lines"] = np.bincount(doc, again, b.n).astype(np.int64)
    # words in windows found twice or more
    h, at = windows(hash_spans(b.data, b.starts, b.ends), woff, REPEAT_WINDOW)
    twice = at[_repeats(h ^ mix(b.doc[at].astype(np.uint64) + np.uint64(1)))]
    edge = np.zeros(len(b.starts) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = per_text(np.cumsum(edge[:-1]) > 0, woff)
    return out


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    n = counts["n_words"]
    return (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PCT * n)


# ---------------------------------------------------------------- features

def features_of(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every feature occurrence of a lower-cased, split
    block."""
    w = hash_spans(b.data, b.starts, b.ends)
    doc = [b.doc]
    keys = [mix(w ^ _W)]
    pair = b.doc[1:] == b.doc[:-1]
    keys.append(mix(w[:-1] * np.uint64(3) + w[1:] + _B)[pair])
    doc.append(b.doc[1:][pair])
    of = np.repeat(np.arange(b.n), np.diff(b.off))
    eight = np.ndarray((len(b.data) + 1,), "<u8", np.concatenate([b.data, np.zeros(8, np.uint8)]), strides=(1,))
    for k in GRAMS:
        if len(b.data) >= k:
            inside = of[k - 1:] == of[:len(of) - k + 1]
            low = eight[:len(of) - k + 1][inside] & np.uint64((1 << 8 * k) - 1)
            keys.append(mix(low + _C * np.uint64(k)))
            doc.append(of[k - 1:][inside])
    return np.concatenate(keys), np.concatenate(doc)


@dataclass
class Head:
    """Weights of one label's features, sorted by feature hash."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -30.0
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def probability(self, keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        hit = np.flatnonzero(self.sieve[(keys >> np.uint64(44)).astype(np.int64)])
        z = np.full(n, self.bias)
        if len(hit) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys[hit]), len(self.keys) - 1)
            hit, at = hit[self.keys[at] == keys[hit]], at[self.keys[at] == keys[hit]]
            once, many = np.unique(doc[hit] * len(self.keys) + at, return_counts=True)
            z += np.bincount(once // len(self.keys), self.weights[once % len(self.keys)] * np.log2(1 + many), n)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -60, 60)))


def _fit(chosen: np.ndarray, x: np.ndarray, y: np.ndarray, train: np.ndarray, weight: np.ndarray) -> Head:
    """Weights of the sorted features ``chosen``; ``x`` has a row a text. Rows
    outside ``train`` calibrate."""
    n1, n0 = int((y[train] == 1).sum()), int((y[train] == 0).sum())
    if not n1 or not n0 or not len(chosen):
        return Head()
    balance = np.where(y == 1, 0.5 / n1, 0.5 / n0) * train
    w, bias, g2, b2 = np.zeros(len(chosen), np.float32), 0.0, np.full(len(chosen), 1e-8, np.float32), 1e-8
    for _ in range(300):  # AdaGrad, full batch
        e = (1 / (1 + np.exp(-np.clip(x @ w + bias, -60, 60))) - y) * balance
        g = x.T @ e.astype(np.float32) + 1e-4 * w
        g2 += g * g
        b2 += e.sum() ** 2
        w -= 0.3 * g / np.sqrt(g2)
        bias -= 0.3 * e.sum() / np.sqrt(b2)
    z, v = (x @ w + bias)[~train], weight[~train]
    t, slope, shift = y[~train], 1.0, 0.0
    if t.min(initial=1) != t.max(initial=0):
        for _ in range(50):  # Platt scaling by Newton steps, with a prior on slope 1
            p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -60, 60)))
            r, s = v * (p - t), v * p * (1 - p) + 1e-12
            grad = np.array([(r * z).sum() + (slope - 1), r.sum() + 0.01 * shift])
            hess = np.array([[(s * z * z).sum() + 1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.01]])
            slope, shift = np.array([slope, shift]) - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return Head(chosen, w.astype(float), float(bias), float(max(slope, 0.05)), float(shift))


def _distinct(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, how often), each feature of a text once."""
    k, d = features_of(b)
    order = np.lexsort((k, d))
    k, d = k[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])) if len(k) else np.zeros(0, int)
    return k[new], d[new], np.diff(np.append(new, len(k)))


def _lower_blocks(batch: pa.RecordBatch):
    texts = text_of(batch)
    for a, e in blocks(texts, HELD):
        b = Block(texts, a, e)
        b.lower()
        b.split()
        yield a, e, b


def _support(sample: DataFrame) -> DataFrame:
    """``(key, c0..c3)``: in how many training texts of each cell a feature is."""
    def work(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            for a, e, b in _lower_blocks(batch):
                k, d, _ = _distinct(b)
                for c in range(4):
                    keys, n = np.unique(k[cell[a:e][d] == c], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), c, np.int32)), pa.array(n)],
                        names=["key", "cell", "n"])

    counts = sample.where("train").mapInArrow(work, "key long, cell int, n long")
    return counts.groupBy("key").agg(*(F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}")
                                       for c in range(4))).where(f"c0 + c1 + c2 + c3 >= {MIN_SUPPORT}")


def _choose(support: DataFrame, ones: list[int], sizes: list[int], n_features: int) -> np.ndarray:
    """The ``n_features`` features whose shares among the texts of the cells
    ``ones`` and of the others differ most (chi-square)."""
    zeros = [c for c in range(4) if c not in ones]
    n1, n0 = sum(sizes[c] for c in ones), sum(sizes[c] for c in zeros)
    if not n1 or not n0:
        return np.zeros(0, np.uint64)
    a, b = (sum((F.col(f"c{c}") for c in cells), F.lit(0)) for cells in (ones, zeros))
    p = (a + b) / (n1 + n0)
    chi = (a / n1 - b / n0) ** 2 / (p * (1 - p) + 1e-9)
    rows = support.select("key", chi.alias("chi")).where("chi > 0").orderBy(F.desc("chi"), "key").limit(n_features).collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, per_cell: int = PER_CELL, n_features: int = FEATURES) -> dict[str, Head]:
    """The heads ``low_quality`` and ``toxic``. At most ``4 * per_cell`` texts
    are looked at, whatever the size of ``labels``."""
    none = {"low_quality": Head(), "toxic": Head()}
    lab = labels.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)") \
        .select(F.col("doc_id").cast("long").alias("doc_id"), (2 * F.col("quality") + F.col("toxic")).cast("int").alias("cell"))
    total = {r["cell"]: r["count"] for r in lab.groupBy("cell").count().collect()}
    picked = []
    for c in sorted(total):
        picked += lab.where(F.col("cell") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_cell).collect()
    if not picked:
        return none
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, lab.schema).dropDuplicates(["doc_id"]))
    sample = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
                         .withColumn("train", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0), "labelled-sample")
    sizes = [0] * 4
    for r in sample.where("train").groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    support = materialize(_support(sample), "feature-support")
    keys = {"low_quality": _choose(support, [0, 1], sizes, n_features), "toxic": _choose(support, [1, 3], sizes, n_features)}
    both = np.unique(np.concatenate(list(keys.values())))
    if not len(both):
        return none

    def work(batches):
        for batch in batches:
            for a, e, b in _lower_blocks(batch):
                k, d, many = _distinct(b)
                at = np.minimum(np.searchsorted(both, k), len(both) - 1)
                hit = both[at] == k
                x = np.zeros((e - a, len(both)), np.float32)
                x[d[hit], at[hit]] = np.log2(1 + many[hit])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, e - a) for c in ("doc_id", "cell", "train")),
                                                  pa.array([r.tobytes() for r in x], pa.binary())],
                                                 names=["doc_id", "cell", "train", "x"])

    rows = sorted(sample.mapInArrow(work, "doc_id long, cell int, train boolean, x binary").collect(),
                  key=lambda r: (r["doc_id"], bytes(r["x"])))  # at most 4 * per_cell, of a fixed width
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    cell, is_train = np.array([r["cell"] for r in rows]), np.array([r["train"] for r in rows])
    taken = np.bincount(cell, minlength=4)
    weight = np.array([total[c] / taken[c] for c in cell])
    of = {"low_quality": cell < 2, "toxic": cell % 2 == 1}
    return {h: _fit(keys[h], x[:, np.isin(both, keys[h])], of[h].astype(int), is_train, weight) for h in keys}


# ------------------------------------------------------------------- score

SCORED = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, p_low_quality double, p_toxic double, kept boolean")


def _score(texts: pa.Array, heads: dict[str, Head], thresholds: dict[str, float]) -> list[np.ndarray]:
    b = Block(texts, 0, len(texts))
    b.split()
    counts = rule_counts(b)
    failed = base_failed(counts)
    b.lower()
    keys, doc = features_of(b)
    p = {k: h.probability(keys, doc, b.n) for k, h in heads.items()}
    kept = ~failed
    for k in p:
        kept &= p[k] < thresholds[k]
    return [*(counts[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            failed, p["low_quality"], p["toxic"], kept]


def score(docs: DataFrame, heads: dict[str, Head], thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """``doc_id`` and the columns of ``SCORED`` for every row."""
    names = ["doc_id", *(c.split()[0] for c in SCORED.split(", "))]

    def work(batches):
        for batch in batches:
            texts, ids = text_of(batch), batch.column("doc_id")
            for a, e in blocks(texts, HELD):
                cols = _score(texts.slice(a, e - a), heads, thresholds)
                yield pa.RecordBatch.from_arrays([ids.slice(a, e - a), *map(pa.array, cols)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, " + SCORED)


def keep_good(docs: DataFrame, heads: dict[str, Head], thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    def work(batches):
        for batch in batches:
            texts = text_of(batch)
            for a, e in blocks(texts, HELD):
                kept = _score(texts.slice(a, e - a), heads, thresholds)[-1]
                yield batch.slice(a, e - a).filter(pa.array(kept))

    return docs.mapInArrow(work, docs.schema)
