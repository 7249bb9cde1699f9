"""Pointers packed for their way, and what many small parts of a partition cost."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import phrases
from tests.llm.test_round3_operators import plain_phrases


def test_many_parts_of_a_partition_cost_little_more_than_few(spark, monkeypatch):
    """A partition has a part of each block, so their number grows with the
    corpus; dictionaries unified part by part took time by its square."""
    monkeypatch.setattr(phrases, "FREQUENT", 1000, raising=False)
    rng = random.Random(3)
    rows = [(i, "en", " ".join(f"w{rng.randrange(200_000)}" for _ in range(300))) for i in range(4000)]
    docs = spark.createDataFrame(rows + [(9, "en", "one two three four")] * 5, "doc_id long, lang string, text string").repartition(4).cache()
    took, got = {}, {}
    for block in (1 << 23, 1 << 23, 1 << 11):  # the first starts the workers
        monkeypatch.setattr(phrases, "BLOCK", block)
        began = time.time()
        got[block] = sorted(tuple(r) for r in phrases.collocations(docs, least=3).collect())
        took[block] = time.time() - began
    docs.unpersist()
    assert got[1 << 11] == got[1 << 23] and any(r[2] == "one two three four" for r in got[1 << 23])
    assert took[1 << 11] < 4 * took[1 << 23] + 15


@pytest.mark.parametrize("frequent", [0, 3, 1 << 17])
def test_words_that_few_or_no_partitions_know(spark, monkeypatch, frequent):
    monkeypatch.setattr(phrases, "FREQUENT", frequent)
    monkeypatch.setattr(phrases, "BLOCK", 300)
    monkeypatch.setattr(phrases, "BATCH", 40)
    monkeypatch.setattr(phrases, "POINTERS", 200)
    rng = random.Random(8)
    rows = [(rng.choice(["en", None, "und", "fr", "x y"]), " ".join(rng.choice(["a", "Éa", "漢字", "b\x00", "c", f"r{rng.randrange(40)}"]) for _ in range(50)))
            for _ in range(60)] + [("en", "a b " * 400)] * 2 + [("en", None), (None, "")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert {tuple(r) for r in phrases.collocations(docs, least=3, top=200).collect()} == plain_phrases(rows, 3, 80, 200)


def test_packed_pointers_come_back():
    """Numbers and weights too large for 16 and 8 bits, stretches with and
    without words of their own, a column that begins inside its buffers."""
    rng = np.random.default_rng(1)
    words = pa.array([f"w{i}" for i in range(90_000)], pa.large_string())
    common = pa.array([f"w{i}" for i in range(0, 140_000, 2)], pa.large_string())
    rows = rng.integers(0, len(words) + 1, (5000, phrases.DEPTH))
    rows[:50] = rows[:50] // 2 * 2 + 1  # w0, w2 ..: all common
    rows[-300:, 2:] = 0
    weight = np.where(rng.random(5000) < 0.1, rng.integers(250, 70_000, 5000), 1)
    first = np.array([0, 50, 51, 3000])
    packed = [c.cast(pa.binary()) for c in phrases._pack(words, common, rows, weight, first)]
    whole = pa.RecordBatch.from_arrays(packed, names=["numbers", "far", "weights", "heavy", "words"])
    assert phrases._parted(whole.column("weights"), "u1")[1].tolist() == [50, 1, 2949, 2000]
    for parts in ([whole], [whole.slice(0, 1), whole.slice(1, 2), whole.slice(3, 1)]):
        back, cols, got = phrases._unpack(parts, common)
        text = [None, *back.to_pylist()]
        assert [[text[x] for x in r] for r in cols.T] == [[None if x == 0 else f"w{x - 1}" for x in r] for r in rows]
        assert got.tolist() == weight.tolist() and len(text) == len(set(text))
    none = phrases._unpack([whole.slice(0, 1)], common)
    assert len(none[0]) == len(common)


def test_hot_starts_of_many_words():
    """Two numbers of a large dictionary make a key of more than 32 bits."""
    words = pa.array([f"w{i}" for i in range(200_000)], pa.large_string())
    cols = [np.array(c, np.int32) for c in ([150_001, 7, 150_001, 150_001], [199_001, 8, 199_002, 199_001], [5, 5, 5, 6])]
    lang = np.array([0, 0, 0, 1])
    at = lambda keys, n: phrases._hot(keys, pa.array(["en", "fr"]), words, lang, cols[:n]).tolist()
    assert at([("en", "w150000", "w199000"), ("fr", "w6", "w7")], 2) == [True, False, False, False]
    assert at([("fr", "w150000", "w199000", "w5"), ("en", "w6", "w7", "w4")], 3) == [False, True, False, True]
