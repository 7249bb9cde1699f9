"""Sharding, phrases and search against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strata.llm import phrases, queries as Q, search, sharding
from strata.session import scratch_path
from tests.llm import brute
from tests.llm.conftest import SMALL, rows_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(params=["edge", "small"])
def data(request, edge_dir):
    return edge_dir if request.param == "edge" else SMALL


# ---------------------------------------------------------------- search

def plain_rank(docs, items, top=20):
    docs = [(d, Counter(TERM.findall(brute.lower(t)))) for d, t in docs]
    docs = [(d, c) for d, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = Counter()
    for i, text in items:
        terms, scored = Counter(TERM.findall(brute.lower(text))), []
        for d, c in docs:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, q in terms.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        for k, (s, none, d) in enumerate(sorted(scored)[:top]):
            out[i, k + 1, None if none else d, -s] += 1
    return out


def items_of(spark, d):
    return list({(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()})


def test_search(spark, data):
    got = Counter(map(tuple, Q.op13_limited_accumulators(spark, data).collect()))
    assert got == plain_rank(rows_of(spark, data), items_of(spark, data))


@pytest.mark.parametrize("rounds", [(1, 2, 3), (100,)])
def test_search_stops_early_without_loss(spark, rounds):
    rng = random.Random(4)
    word = lambda: f"w{int(40 * rng.random() ** 3)}"
    docs = [(i % 150, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(300)] + [(None, "w1 w30")] * 3
    items = [(i, " ".join(word() for _ in range(8))) for i in range(6)] + [(9, "w1 w1 w30 W30!"), (10, "nothing"), (None, "w2")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, search.rank(d, b, 5, rounds).collect())) == plain_rank(docs, items, 5)


def test_search_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_PAIRS", 0)
    got = Counter(map(tuple, Q.op13_limited_accumulators(spark, SMALL).collect()))
    assert got == plain_rank(rows_of(spark, SMALL), items_of(spark, SMALL))


# ---------------------------------------------------------------- phrases

def plain_phrases(rows, least=30, cover=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = set()
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], a)
        rows = []
        for p, a in cand.items():
            if 100 * longer[p] >= cover * a:
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.add((lang, r + 1, p.decode(), -a, left, right, n[lang], -s))
    return out


def langs_of(spark, d):
    return [(r["lang"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]


def test_phrases(spark, data):
    got = [tuple(r) for r in Q.op12_suffix_quicksort(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_phrases(langs_of(spark, data))


@pytest.mark.parametrize("pointers", [50, 1 << 20])
def test_phrases_over_many_partitions_and_hot_starts(spark, monkeypatch, pointers):
    """Few words in all, so that most starts are hot and their parts added up."""
    monkeypatch.setattr(phrases, "POINTERS", pointers)
    rng = random.Random(5)
    word = lambda: ["of", "The", "á", "b-c", "x"][int(5 * rng.random() ** 2)] if rng.random() < 0.8 else f"r{rng.randrange(90)}"
    rows = [(rng.choice(["en", None, "und", "fr"]), " ".join(word() + rng.choice(["", "", "", ".", "\x0b", "\t"]) for _ in range(40)))
            for _ in range(60)] + [("en", "of the of the of the of the"), ("en", None), ("de", ""), ("xx", " .,;")]
    docs = spark.createDataFrame([(i, t, lang, 7) for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, phrase int").repartition(7)
    got = {tuple(r) for r in phrases.collocations(docs, least=3, top=150).collect()}
    want = plain_phrases(rows, 3, 80, 150)
    assert {r for r in want if r[0] in ("de", "xx")} == set() and got == want


# ---------------------------------------------------------------- sharding

def cheapest(supply, capacity, cost):
    """Every way to send whole units; only for a few."""
    units = [i for i, s in enumerate(supply) for _ in range(s)]
    best = None
    for to in itertools.product(range(len(capacity)), repeat=len(units)):
        if all(c <= cap for c, cap in zip((to.count(j) for j in range(len(capacity))), capacity, strict=True)):
            total = sum(cost(i, j) for i, j in zip(units, to, strict=True))
            best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_the_cheapest(seed):
    rng = random.Random(seed)
    supply = [rng.randrange(4) for _ in range(3)]
    capacity = [rng.randrange(1, 5) for _ in range(3)]
    capacity[0] += max(0, sum(supply) - sum(capacity))
    table = [[rng.randrange(6) for _ in capacity] for _ in supply]
    cost = lambda i, j: table[i][j]
    flow = sharding.minimum_cost_flow(supply, capacity, cost)
    assert [sum(r) for r in flow] == supply and all(sum(r[j] for r in flow) <= c for j, c in enumerate(capacity))
    assert sum(cost(i, j) * x for i, r in enumerate(flow) for j, x in enumerate(r)) == cheapest(supply, capacity, cost)


def test_flow_moves_the_least_and_needs_room():
    flow = sharding.minimum_cost_flow([50, 10, 0], [20, 20, 20])
    assert sum(x for i, r in enumerate(flow) for j, x in enumerate(r) if i != j) == 30
    with pytest.raises(ValueError, match="smaller"):
        sharding.minimum_cost_flow([3], [2])


def check_shards(got, docs, shards):
    size = lambda t: len((t or "").encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == \
        Counter((d, size(t) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    held, slots = Counter(), defaultdict(list)
    for r in got:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return held


def test_sharding(spark, data):
    docs = rows_of(spark, data)
    held = check_shards(Q.op11_flow_resharding(spark, data).collect(), docs, 24)
    sizes = sorted((len((t or "").encode()) + 8 for _, t in docs), reverse=True)
    assert max(held.values()) <= sum(sizes) / 24 + sizes[0]


def test_moves_the_fewest_bytes_and_leaves_the_rest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = scratch_path(spark, "t")
    old = sharding.table(spark, sharding.write_shards(docs, f"{path}/a", 5, F.xxhash64("source")), docs)
    was = {r["shard"]: r["bytes"] for r in old.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    total = sum(was.values())
    capacity = [total // 2, total // 8, total // 8, total // 8, 0, total - total // 2 - 3 * (total // 8)]
    folders, rule = sharding.reshard(old, capacity, f"{path}/b")
    moved = sharding.table(spark, f"{path}/b", docs)
    rows = sharding.resharded(old, folders, moved)
    now = {r["shard"]: r["bytes"] for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    fewest = sum(max(0, b - capacity[s]) for s, b in was.items())
    sent = old.join(rule, ["shard", "tier", "part"]).where("place >= low and place < high and target <> shard").agg(F.sum("size")).first()[0]
    slack = 0.02 * total / 6
    assert all(abs(now.get(j, 0) - c) <= slack for j, c in enumerate(capacity)) and abs(sent - fewest) <= 6 * slack
    assert rows.count() == docs.count() and rows.select("row.*").exceptAll(docs).isEmpty()
    losers = {s for s, b in was.items() if b > capacity[s]}
    assert {r["shard"] for r in folders.select("shard").distinct().collect()} <= losers


def test_rows_that_are_not_files_and_one_hot_row(spark):
    rows = [(None, "same text")] * 3000 + [(i, f"text {i}" * 3) for i in range(1000)] + [(1, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as size", "3 as place").repartition(6)
    path = scratch_path(spark, "t")
    old = sharding.table(spark, sharding.write_shards(docs, f"{path}/a", 4, F.xxhash64("doc_id")), docs)
    folders, _ = sharding.reshard(old, 7, f"{path}/b")
    got = sharding.resharded(old, folders, sharding.table(spark, f"{path}/b", docs)).selectExpr(
        "row.doc_id", "size", "crc as text_crc32", "'bytes' as law", "shard", "slot", "null as grown_shard").collect()
    held = check_shards(got, rows, 7)
    assert len(held) == 7 and max(held.values()) - min(held.values()) < 200
