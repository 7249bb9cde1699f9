"""The pipeline against plain versions, stage by stage on each one's input,
and what only the operators' own interfaces show."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from strata.llm import pii, queries as Q, token_files
from strata.llm.bpe import encode_text
from strata.llm.encode import Encoder
from strata.llm.packing import plan_runs
from strata.session import scratch_path
from tests.llm import brute
from tests.llm.conftest import SMALL


@pytest.mark.parametrize("which", ["edge", "small"])
def test_stages(spark, edge_dir, which):
    d = edge_dir if which == "edge" else SMALL
    docs = spark.read.parquet(f"{d}/documents.parquet")
    tables = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "t") + "/s"
        stage(spark, docs, d).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != "best-fit packing":
            assert docs.columns == before.columns
        tables.append(docs.collect())
    raw, good, single, cut, masked, packed = tables
    pair = lambda rows: [(r["doc_id"], r["text"]) for r in rows]
    kept = {(r["doc_id"], r["n_words"]) for r in Q.op7_ngram_quality(spark, d).collect() if r["kept"]}
    assert Counter(r for r in raw if (r["doc_id"], len(brute.words(r["text"]))) in kept) == Counter(good)
    first = {i for i, _, c in brute.components(pair(good)) if i == c or c is None}
    assert Counter(r for r in good if r["doc_id"] in first) == Counter(single)
    want = Counter()
    for (i, n, gone, digest), k in brute.dedup(pair(single)).items():
        want[i, n - gone, digest] += k
    assert Counter((i, len(brute.words(t)), brute.sha(" ".join(brute.words(t)))) for i, t in pair(cut)) == want
    assert [len(r["text"] or "") for r in masked if r["n_chars"] is not None and r["n_chars"] != len(r["text"] or "")] == []
    assert Counter(r["doc_id"] for r in masked) == Counter(r["doc_id"] for r in cut)
    clean = Counter(r for r in cut if not brute.base_spans(r["text"]))
    assert clean == Counter(r for r in masked if r in clean)
    assert not any(brute.base_spans(r["text"]) for r in masked)
    t = brute.tok("word_bpe_49k.json")
    assert sum(r["length"] for r in packed) == sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in masked)


def test_tree_concatenation():
    rng = np.random.default_rng(2)
    letters = ["a", "b", "the", "ing", "é", "'ll", "'s", "1", "!", "<|endoftext|>", "é", "Σ", "th", "er", " ", "\n", "漢"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = Encoder.at(Q.tokenizer(name))
        for _ in range(300):
            some = rng.choice(letters, rng.integers(1, 8))
            text = "".join(rng.choice(some, rng.integers(0, 200)))
            assert encode_text(enc, text, leaf=int(rng.integers(2, 40))).tobytes() == enc.whole(text)
            assert enc.encode([text])[0] == enc.whole(text)


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4095, 4096, 4097, 100_000):
        ids = np.minimum(rng.zipf(1.3, n), 50_256).astype(np.uint32)
        table, coded = token_files.encode_segment(ids)
        table = token_files.Table.unpack(table)
        assert (np.concatenate([token_files.decode_block(b, table) for b in coded]) == ids).all()
        a, b = n // 3, 2 * n // 3
        assert (token_files.decode_block(coded[0], table, a, b) == ids[a:b]).all()
    raw = bytearray(coded[0])
    raw[len(raw) - len(raw) // 3] ^= 64
    with pytest.raises(ValueError, match="checksum|states|not a"):
        token_files.decode_block(bytes(raw), table)
    for counts in (np.arange(1, 50_000), np.array([10**12] + [1] * 50_000), np.array([5])):
        f = token_files.frequencies(counts)
        assert f.sum() == 1 << token_files.SCALE and f.min() >= 1


def test_plan_is_no_worse_than_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(300):
        capacity = int(rng.choice([10, 20, 50, 100]))
        items = rng.integers(1, capacity + 1, rng.integers(0, 60))
        counts = dict(Counter(items.tolist()))
        runs, n = plan_runs(counts, capacity)
        load = Counter()
        ranks = Counter()
        for w, a, b, seq, at in runs:
            for k in range(b - a):
                load[seq + k] += w
            ranks[w] += b - a
        assert dict(ranks) == counts and max(load.values(), default=0) <= capacity and len(load) == n
        rooms = []
        for x in sorted(items.tolist(), reverse=True):
            fit = [r for r in rooms if r >= x]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - x)
            else:
                rooms.append(capacity - x)
        assert n <= len(rooms)


def test_field_adds_repeats_only(spark):
    text = ("call +1 (017) 555-7713 now; later 1 (017) 555-7713 again, and 017 555-7713; "
            "code 9807915762804490 twice 9807915762804490; version 2.0.")
    more = [(i, f"call +1 ({100 + i}) 555-{1000 + 7 * i} please, number {9807915762804490 + 2 * i}") for i in range(60)]
    docs = spark.createDataFrame([(1000, text), *more], "doc_id long, text string")
    field = pii.train(docs)
    rows = {r["doc_id"]: r for r in pii.find(docs, field).collect()}
    spans = [s for s in rows[1000]["spans"].split(",") if s]
    assert rows[1000]["n_phone"] == 1 and rows[1000]["n_added"] >= 1
    assert all(s.startswith("phone") for s in spans) and not any(s.endswith(":104") for s in spans)
    assert all(r["n_added"] == 0 for i, r in rows.items() if i != 1000)


def test_classifier_on_held_out_labels(spark):
    from strata.llm import quality

    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.where("doc_id % 2 = 0")
    got = quality.score(docs, quality.train(docs, fit)).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    toxic = [r["p_toxic"] >= 0.5 for r in got if r["toxic"] == 1]
    bad = [not r["kept"] for r in got if r["quality"] == 0]
    clean = [r["kept"] for r in got if r["quality"] == 1 and r["toxic"] == 0 and not r["base_failed"]]
    assert np.mean(toxic) > 0.8 and np.mean(bad) > 0.95 and np.mean(clean) > 0.99


