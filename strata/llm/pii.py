"""Personal data by patterns and a skip-chain conditional random field.

The patterns (:func:`base_spans`) give certain spans. The field reads every
span-like stretch of a text (digits with separators, or an at sign between
words) as a node with the labels none, email, ip, card, phone. A node has
features of its shape; neighbours in the text share a chain potential; and
nodes that repeat or resemble one another (same letters and digits; same last
seven digits; same name before the at sign) are joined to the nearest such
node before them by a skip potential, however far apart. Pattern spans are
observed. Loopy sum-product message passing makes the labels of one document
agree, and a node whose probability of a label passes ``THRESHOLD`` without
having matched a pattern becomes an added span.

Weights come from counts over the whole corpus, gathered as one small table
(shapes and label pairs are bounded sets): a softmax on shape, trained on the
pattern labels with the pattern's own mark hidden in turn, and the log odds of
label pairs on chain and skip edges.

Edge cases: a null or empty text has no spans; a null ``doc_id`` is scanned
like any other; repeated rows come out once each; an empty corpus trains a
field that adds nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.arrays import blocks, text_of

KINDS = ("email", "ip", "card", "phone")
THRESHOLD, ROUNDS, DAMPING = 0.9, 15, 0.5
#: Fixed by the contract.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")

#: Stretches that may be personal data: a name, a mark and a domain of any
#: length, or digits, of which no kind has more than 19.
_MARKS = ("@", "(at)", "[at]")
_MAIL = re.compile(r"\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]+)*")
_NUMBER = re.compile(r"(?:\+|\b00)?\(?[0-9](?:[\x20().-]{0,2}[0-9]){5,23}")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the letters before each at sign, a domain after it.
    Linear however long the runs are."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        nxt = at + 1
        if m and at >= done:
            a = at
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            if a < at:
                out.append((a, m.end()))
                done = nxt = m.end()
        at = text.find("@", nxt)
    return out


def _stretches(text: str) -> list[tuple[int, int]]:
    """Leftmost stretches, none over another; at one start mail goes first."""
    out, done = [], 0
    mail = _MAIL.search(text) if any(m in text for m in _MARKS) else None
    number, name = _NUMBER.search(text), -1
    while mail or number:
        if mail and name < 0:  # back from the mark, once
            name = mail.start()
            while name > done and text[name - 1] in _LOCAL:
                name -= 1
        if mail and (not number or max(name, done) <= number.start()):
            out.append((max(name, done), mail.end()))
            done, name = mail.end(), -1
            mail = _MAIL.search(text, done)
            if number and number.start() < done:
                number = _NUMBER.search(text, done)
        else:
            out.append(number.span())
            done = number.end()
            if mail and mail.start() < done:
                mail, name = _MAIL.search(text, done), -1
            number = _NUMBER.search(text, done)
    return out


def base_spans(text: str) -> list[Span]:
    """All spans of the patterns, by start, then kind."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text) if "." in text else ():
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start():
                d = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# ------------------------------------------------------------------- field

#: A node's shape: digits (bucketed), separators, marks. Bounded, so counts of
#: shapes over any corpus are one small table.
_BUCKET = np.searchsorted([1, 7, 9, 12, 13, 16, 17, 20], np.arange(200), "right")


def shape(s: str, hide: bool = False) -> int:
    """Bits of one stretch. ``hide`` leaves out what the patterns hang on."""
    d = _NOT_DIGIT.sub("", s)
    dots = s.count(".")
    mail = "@" in s or "(at)" in s or "[at]" in s
    bits = int(_BUCKET[min(len(d), 199)])
    bits |= (mail << 4) | ((dots == 3 and not mail) << 5) | (("(" in s and not mail) << 6) | (("-" in s and not mail) << 7)
    bits |= (12 <= len(d) <= 19 and not mail and luhn(d)) << 8
    if not hide:
        bits |= s.startswith("+") << 9
    return bits | (hide << 10)


N_BITS = 11


def _vector(bits: np.ndarray) -> np.ndarray:
    """One-hot digits bucket, the marks, and a constant."""
    x = np.zeros((len(bits), 16 + 6 + 1))
    x[np.arange(len(bits)), bits & 15] = 1
    for k in range(6):
        x[:, 16 + k] = (bits >> (4 + k)) & 1
    x[:, -1] = 1
    return x


@dataclass
class Field:
    unary: np.ndarray  # (features, labels)
    chain: np.ndarray  # (labels, labels), log potentials
    skip: np.ndarray


def nodes_of(text: str, base: list[Span]) -> tuple[list[Span], list[int]]:
    """Stretches (start, end, label or -1) in order, pattern spans among them;
    -1 is a stretch no pattern took."""
    out = [(a, b, k + 1) for a, b, k in base]
    taken = sorted((a, b) for a, b, _ in base)
    i = 0
    for a, b in _stretches(text):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if not any(x < b and a < y for x, y in taken[i:i + 2]):
            out.append((a, b, -1))
    out.sort()
    return out, [n[2] for n in out]


def _names(s: str) -> list[tuple]:
    """What makes two stretches repeat or resemble one another."""
    if "@" in s or "(at)" in s or "[at]" in s:
        whole = re.sub(r"\x20?(?:@|\(at\)|\[at\])\x20?", "@", s.lower())
        whole = re.sub(r"\x20?(?:\(dot\)|\[dot\])\x20?", ".", whole)
        return [("m", whole), ("n", whole.split("@")[0])]
    d = _NOT_DIGIT.sub("", s)
    return [("d", d), ("e", d[-7:])]


def edges_of(text: str, nodes: list[Span]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain and skip edges. A node is joined to the nearest earlier node of
    each name only, so a text's edges are as many as its nodes."""
    skip, last = set(), {}
    for i, (a, b, _) in enumerate(nodes):
        for key in _names(text[a:b]):
            if key in last:
                skip.add((last[key], i))
            last[key] = i
    return [(i, i + 1) for i in range(len(nodes) - 1)], sorted(skip)


STATS = "what string, a int, b int, n long"


def gather(docs: DataFrame) -> DataFrame:
    """Counts over all documents: ``shape`` (bits, label), ``chain`` and
    ``skip`` (label pairs; unmatched stretches count as none)."""
    def work(batches):
        for batch in batches:
            counts: dict[tuple, int] = {}
            texts = text_of(batch)
            for text in (t for a, b in blocks(texts) for t in texts.slice(a, b - a).to_pylist()):
                if not _DIGIT.search(text) and not any(m in text for m in _MARKS):
                    continue
                nodes, labels = nodes_of(text, base_spans(text))
                chain, skip = edges_of(text, nodes)
                y = [max(0, k) for k in labels]
                for (a, b, _), k in zip(nodes, y, strict=True):
                    for hide in (False, True):
                        key = ("shape", shape(text[a:b], hide), k)
                        counts[key] = counts.get(key, 0) + 1
                for what, edges in (("chain", chain), ("skip", skip)):
                    for i, j in edges:
                        counts[what, y[i], y[j]] = counts.get((what, y[i], y[j]), 0) + 1
            if counts:
                keys = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys]), *(pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)),
                     pa.array(list(counts.values()), pa.int64())], names=["what", "a", "b", "n"])

    return docs.select("text").mapInArrow(work, STATS).groupBy("what", "a", "b").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Field:
    rows = gather(docs).collect()  # bounded by the number of shapes and label pairs
    n = 1 + len(KINDS)
    shapes = sorted((r["a"], r["b"], r["n"]) for r in rows if r["what"] == "shape")
    w = np.zeros((16 + 6 + 1, n))
    if shapes:
        bits, y, c = (np.array(v) for v in zip(*shapes, strict=True))
        x, t = _vector(bits), np.eye(n)[y]
        c = c / c.sum()
        g2 = np.full(w.shape, 1e-8)
        for _ in range(400):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ ((p - t) * c[:, None]) + 1e-4 * w
            g2 += g * g
            w -= 0.3 * g / np.sqrt(g2)
    else:
        w[-1, 0] = 10.0

    def odds(what: str, prior: np.ndarray) -> np.ndarray:
        m = prior.copy()
        for r in rows:
            if r["what"] == what:
                m[r["a"], r["b"]] += r["n"] / 2
                m[r["b"], r["a"]] += r["n"] / 2
        m /= m.sum()
        own = m.sum(1)
        return np.clip(np.log(m / np.outer(own, own)), -4, 4)

    same = np.ones((n, n)) + 9 * np.eye(n)
    return Field(w, np.clip(odds("chain", np.ones((n, n))), -0.5, 0.5), odds("skip", same))


def marginals(unary: np.ndarray, edges: list[tuple[int, int, int]], pair: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product. ``edges``: (i, j, which of ``pair``)."""
    unary = unary - unary.max(1, keepdims=True)
    if edges:
        i, j, k = np.array(edges).T
        src, dst, pot = np.concatenate([i, j]), np.concatenate([j, i]), np.exp(np.concatenate([pair[k], pair[k].transpose(0, 2, 1)]))
        back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
        msg = np.zeros((len(src), unary.shape[1]))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, dst, msg)
            into = total[src] - msg[back]
            into = np.exp(into - into.max(1, keepdims=True))
            new = np.log(np.einsum("ea,eab->eb", into, pot) + 1e-300)
            msg = DAMPING * msg + (1 - DAMPING) * (new - new.max(1, keepdims=True))
        unary = unary.copy()
        np.add.at(unary, dst, msg)
    p = np.exp(unary - unary.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    nodes, labels = nodes_of(text, base)
    if -1 not in labels:
        return []
    chain, skip = edges_of(text, nodes)
    if not skip:  # nothing to agree with: shape alone never adds a span
        return []
    unary = _vector(np.array([shape(text[a:b], hide=k < 0) for a, b, k in nodes])) @ field.unary
    for i, k in enumerate(labels):
        if k >= 0:
            unary[i] = -50
            unary[i, k] = 0
    edges = [(i, j, 0) for i, j in chain] + [(i, j, 1) for i, j in skip]
    p = marginals(unary, edges, np.stack([field.chain, field.skip]))
    linked = {i for e in skip for i in e}
    return [(a, b, int(p[i].argmax()) - 1) for i, (a, b, k) in enumerate(nodes)
            if k < 0 and i in linked and p[i].argmax() > 0 and p[i].max() >= THRESHOLD]


def show(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id``, the number of pattern spans of each kind, their digest and
    all spans (``kind:start:end``, code points)."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def work(batches):
        for batch in batches:
            texts = text_of(batch)
            for a, b in blocks(texts):
                rows = []
                for t in texts.slice(a, b - a).to_pylist():
                    base = base_spans(t)
                    new = added_spans(t, base, field)
                    rows.append((*(sum(s[2] == k for s in base) for k in range(len(KINDS))),
                                 hashlib.sha256(show(base).encode()).hexdigest(), show(base + new), len(new)))
                kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a)]
                    + [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string, n_added long")


def mask(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with all its columns; each span of ``text`` replaced by its
    kind in brackets (overlapping spans by the first's), ``n_chars`` following
    if there. Texts without spans stay as they are, null ones null."""
    names = docs.columns

    def hide(t: str | None) -> str | None:
        base = base_spans(t) if t else []
        spans = base + added_spans(t, base, field) if t else []
        if not spans:
            return t
        out, at = [], 0
        for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
            if a >= at:
                out += [t[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def work(batches):
        for batch in batches:
            for a, b in blocks(text_of(batch)):
                some = batch.slice(a, b - a)
                old = some.column("text").to_pylist()
                new = [hide(t) for t in old]
                cols = [pa.array(new, some.schema.field("text").type) if n == "text" else some.column(n) for n in names]
                if "n_chars" in names:
                    was = some.column("n_chars").to_pylist()
                    cols[names.index("n_chars")] = pa.array(
                        [w if x == y else len(y) for w, x, y in zip(was, old, new, strict=True)],
                        some.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(cols, schema=some.schema)

    return docs.mapInArrow(work, docs.schema)
