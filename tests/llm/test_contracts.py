"""Every query against a plain version of its contract, on the awkward table
and on the smallest driver table."""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strata.llm import lbl, packing, pii, queries as Q, warc
from strata.session import scratch_path
from tests.llm import brute
from tests.llm.conftest import SMALL, rows_of


@pytest.fixture(params=["edge", "small"])
def data(request, edge_dir):
    return edge_dir if request.param == "edge" else SMALL


def run(spark, name, d):
    f = next(f for k, f in Q.QUERIES.items() if k.startswith(f"op{name}_"))
    return f(spark, d).collect()


def test_packing(spark, data):
    t, want = brute.tok("word_bpe_49k.json"), Counter()
    for d, text in rows_of(spark, data):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[d, k, a, len(ids[a:a + 4096]), brute.crc(ids[a:a + 4096])] += 1
    got = run(spark, 1, data)
    assert Counter(tuple(r)[:5] for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    sizes = sorted((r["length"] for r in got), reverse=True)
    bins = []
    for x in sizes:  # best fit, longest first
        i = min((i for i, b in enumerate(bins) if b >= x), key=lambda i: bins[i], default=None)
        if i is None:
            bins.append(4096 - x)
        else:
            bins[i] -= x
    assert len(seqs) <= len(bins)


def test_packing_with_ids(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    for r in packing.pack_documents(docs, Q.tokenizer("word_bpe_49k.json"), capacity=50, with_ids=True).collect():
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] <= 200


def test_personal_data(spark, data):
    got = run(spark, 2, data)
    want = Counter()
    for d, text in rows_of(spark, data):
        s = brute.base_spans(text)
        want[(d, *(sum(x.startswith(k) for x in s.split(",")) for k in pii.KINDS), brute.sha(s))] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    base = {(d, brute.sha(brute.base_spans(t))): set(brute.base_spans(t).split(",")) for d, t in rows_of(spark, data)}
    for r in got:
        assert base[r["doc_id"], r["base_sha256"]] <= set(r["spans"].split(","))


def test_fingerprints(spark, data):
    rows = sorted(rows_of(spark, data), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    rows = [(d, t or "") for d, t in rows]
    want = Counter()
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        want[d, len(t), brute.sha(t[:len(t) - half] + n[:half])] += 1
    got = run(spark, 3, data)
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    same = defaultdict(set)
    by = {d: t for d, t in rows if Counter(x for x, _ in rows)[d] == 1}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] in by:
            same[by[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert len({next(iter(v)) for v in same.values()}) >= len(same) - 1  # blank texts of other bytes may differ
    if data == SMALL:
        assert np.mean([0.25 < r["near_edited"] < 0.75 for r in got if r["n_chars"] > 1000]) > 0.95


def test_bpe(spark, data):
    t = brute.tok("word_bpe_49k.json")
    want = Counter()
    for d, text in rows_of(spark, data):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             brute.sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, run(spark, 4, data))) == want


def test_token_files(spark, data):
    t = brute.tok("byte_bpe_50k.json")
    rows = sorted(rows_of(spark, data), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = Counter(), 0
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want[d, at, len(ids), brute.crc(ids)] += 1
        at += len(ids)
    assert Counter(map(tuple, run(spark, 5, data))) == want


def test_substrings(spark, data):
    assert Counter(map(tuple, run(spark, 6, data))) == brute.dedup(rows_of(spark, data))


def test_quality_rules(spark, data):
    got = run(spark, 7, data)
    want = Counter((d, *brute.rules(t)) for d, t in rows_of(spark, data))
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in cols) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_simhash(spark, data):
    assert Counter(map(tuple, run(spark, 8, data))) == brute.components(rows_of(spark, data))


def test_warc(spark, data):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    newest = {}
    for p, h in pages:
        newest[h] = max(newest.get(h, -math.inf), -math.inf if p is None else p)
    want = Counter()
    for p, h in pages:
        again = (-math.inf if p is None else p) < newest[h]
        want[p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response",
             newest[h] if again else None] += 1
    assert Counter(map(tuple, run(spark, 9, data))) == want


def test_warc_records_and_damage(spark, edge_dir):
    path = warc.write_archive(spark.read.parquet(f"{edge_dir}/pages.parquet"), scratch_path(spark, "t") + "/a")
    records = [bytes(r["record"]) for r in warc.read_records(spark, path).collect()]
    assert len(records) == 8 and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
    assert sum(b"\r\n\r\n<p>x</p>\r\n\r\n" in r for r in records) == 1
    assert not any(b"\r\nX: y" in r for r in records)
    spark.read.parquet(f"{path}/payloads").selectExpr("strong", "cast('bad' as binary) as payload").write.parquet(f"{path}2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}2/headers")
    with pytest.raises(Exception, match="payload is not"):
        warc.read_index(spark, f"{path}2").collect()


def test_language_model(spark, data):
    rows = rows_of(spark, data)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    docs = [(d, [*brute.words(brute.lower(t)), None]) for d, t in rows]
    c = Counter(w for d, ws in docs if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, ws in docs:
        want[d, held(d), len(ws), sum(c[w] > 0 for w in ws), n,
             round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)] += 1
    got = run(spark, 10, data)
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_language_model_is_normalised_and_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cls = lbl.classes(lbl.count_words(docs))
    model = lbl.train(docs, cls)
    log_z = model.log_z()
    every = np.arange(cls.n)
    for one, two in ((0, 1), (5, 600 % cls.n), (cls.n, cls.n)):
        p = np.exp(model.log_probabilities(every, np.full(cls.n, one), np.full(cls.n, two), log_z))
        assert abs(p.sum() - 1) < 1e-3
    rows = [r for r in lbl.score(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert Q.QUERIES[name](spark, empty_dir).collect() == []


def test_words_go_by_the_longest_windows_found(spark):
    """A passage of 60 words goes by windows of 52, made by doubling, not by its 13-word ones."""
    from strata.llm import substrings
    passage = [f"p{i}" for i in range(60)]
    texts = {1: ["a"] * 3 + passage, 2: ["b"] * 5 + passage + ["c"] * 4, 3: passage[:20] + ["d"], 4: passage[10:40]}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    copies = substrings._copies(substrings.plain_rows(docs), substrings.WINDOW)
    hits = substrings._hits(substrings.candidates(docs, copies, substrings.WINDOW, substrings.ANCHOR)).collect()
    got = {r["id"]: {(g["at"], g["n"]) for g in r["gone"]} for r in hits}
    assert got == {2: {(5 + k, 52) for k in range(9)} | {(5 + k, 26) for k in range(9, 26)},
                   3: {(k, 13) for k in range(8)},
                   4: {(k, 26) for k in range(5)} | {(k, 13) for k in range(5, 13)}}
    left = {r["doc_id"]: r["n_removed"] for r in substrings.dedup(docs).collect()}
    assert left == {1: 0, 2: 60, 3: 20, 4: 30}


def test_longest_repeats(spark):
    from strata.llm import substrings

    body = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(body)), (2, "x " + " ".join(body[:55]) + " y"), (3, "z " + " ".join(body[20:35])), (4, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["longest"] for r in substrings.dedup(docs, maximal=True).collect()}
    assert got == {1: 0, 2: 52, 3: 13, 4: 0}
