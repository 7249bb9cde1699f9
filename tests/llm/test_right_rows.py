"""Rows that were once wrong: joins under marks and special tokens, rows told
apart by too few bits, scores that followed the splits."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from strata.llm import bpe, lbl, queries as Q, substrings
from strata.llm.encode import Encoder
from tests.llm import brute

MARKS = [chr(c) for c in (*range(0x300, 0x31A), 0x323, 0x327, 0x345, 0x5B0, 0x64B, 0x3099)]


def _odd(rng: random.Random) -> str:
    kinds = [lambda: rng.choice("abcXYZ éÅ한ᄀ각ᅡᆨのか漢Ωß'"), lambda: "".join(rng.choices(MARKS, k=rng.randrange(1, 40))),
             lambda: rng.choice(["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>"]), lambda: rng.choice([" ", "\n", "  ", "'s", "12"])]
    return "".join(rng.choice(kinds)() for _ in range(rng.randrange(20, 120)))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tree_under_marks_and_special_tokens(name):
    enc, rng = Encoder.at(Q.tokenizer(name)), random.Random(11)
    texts = [_odd(rng) for _ in range(400)] + ["a" + "".join(rng.choices(MARKS, k=600)) for _ in range(30)]
    bad = [t for t in texts for leaf in (7, 100) if bpe.encode_text(enc, t, leaf).tolist() != enc.tok.encode(t, add_special_tokens=False).ids]
    assert not bad


def test_long_text_of_marks_at_the_default_leaf(spark):
    rng, t = random.Random(3), brute.tok("word_bpe_49k.json")
    text = "a" + "".join(rng.choices(MARKS, k=33_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ids = bpe.encode_documents(docs, Q.tokenizer("word_bpe_49k.json")).first()["ids"]
    assert bytes(ids) == b"".join(i.to_bytes(4, "little") for i in t.encode(text, add_special_tokens=False).ids)


def _same_start(make) -> tuple[str, str]:
    """Two texts whose word digests share their first 32 bits."""
    seen: dict[str, str] = {}
    for i in range(1_000_000):
        text = make(i)
        h = hashlib.sha256(text.encode()).hexdigest()[:8]
        if h in seen:
            return seen[h], text
        seen[h] = text
    raise AssertionError


def test_rows_under_one_id_whose_tags_share_32_bits(spark):
    """Only one of the two repeats a passage of another document."""
    p, q = brute.PASSAGE, " ".join(f"own{i}" for i in range(40))
    one, two = _same_start(lambda i: f"{p if i % 2 else q} n{i}")
    rows = [(1, p), (None, one), (None, two), (2, q)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup(docs).collect())
    assert got == brute.dedup(rows)
    left = Counter(r["text"] for r in substrings.drop_repeats(docs).collect() if r["doc_id"] is None)
    assert set(left) == {t.split(" ")[-1] for t in (one, two)}


def test_substrings_of_long_texts_and_of_rows_that_differ_in_spaces(spark):
    """Passages beyond one chunk of places, and copies under one id."""
    p = brute.PASSAGE
    far = " ".join([*(f"w{i}" for i in range(70_000)), p, *(f"v{i}" for i in range(70_000)), p])
    rows = [(1, p), (4, far), (4, far), (5, p), (5, p.replace(" ", "  ")), (5, p + " end"), (None, far + " end"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup(docs).collect())
    assert got == brute.dedup(rows)
    assert all(n > 0 for i, _, n, _ in got if i in (4, 5))


def test_dropping_repeats_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "__id", "__marks", "__more", "row", "marks", "id", "tag", "more"]
    rows = [(1, brute.PASSAGE, *range(8)), (2, f"own {brute.PASSAGE}", *range(8, 16))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names[2:]))
    out = substrings.drop_repeats(docs)
    assert out.columns == names
    assert sorted(map(tuple, out.collect())) == [rows[0], (2, "own", *range(8, 16))]


def test_scores_do_not_follow_the_splits(spark, monkeypatch):
    monkeypatch.setattr(lbl, "PART", 9000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = (sorted(map(tuple, lbl.score(docs.repartition(n)).collect())) for n in (1, 8))
    assert all(a[:5] == b[:5] and abs(a[6] - b[6]) < 1e-6 * abs(a[6]) for a, b in zip(one, many, strict=True))
