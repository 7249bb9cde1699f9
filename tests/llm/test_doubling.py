import random

import numpy as np
from pyspark.sql import functions as F

from strata.llm import arrays
from strata.llm import substrings as sub


def docs_of(spark, texts):
    return spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")


def brute_gone(texts):
    """Windows that start in an earlier document, without those that one of twice the length begins or ends with."""
    out = {}
    for i, words in texts.items():
        hits, n = {}, sub.WINDOW
        while n <= len(words):
            early = {tuple(w[k:k + n]) for j, w in texts.items() if j < i for k in range(len(w) - n + 1)}
            hits[n] = {k for k in range(len(words) - n + 1) if tuple(words[k:k + n]) in early}
            n *= 2
        gone = {(k, n) for n, at in hits.items() for k in at if not {k, k - n} & hits.get(2 * n, set())}
        if gone:
            out[i] = gone
    return out


def test_ragged_repeats_at_all_levels(spark):
    rnd, base = random.Random(5), [f"w{i}" for i in range(260)] + ["x", "y"] * 40
    texts = {}
    for i in range(1, 25):
        parts = [base[(a := rnd.randrange(300)):a + rnd.randrange(10, 180)] for _ in range(3)]
        texts[i] = [f"own{i}"] + [w for k, p in enumerate(parts) for w in [*p, f"gap{i}_{k}"]]
    docs = docs_of(spark, texts)
    copies = sub._copies(sub.plain_rows(docs), sub.WINDOW)
    hits = sub._hits(sub.candidates(docs, copies, sub.WINDOW, sub.ANCHOR)).collect()
    assert {r["id"]: {(g["at"], g["n"]) for g in r["gone"]} for r in hits} == brute_gone(texts)


def test_levels_move_no_windows_of_equal_stretches(spark, monkeypatch):
    passage = [f"p{i}" for i in range(200)]
    texts = {i: [f"a{i}"] + passage + [f"b{i}"] for i in range(1, 9)}
    rows, written = {}, sub.materialize

    def count(df, name):
        out = written(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(sub, "materialize", count)
    got = {r["doc_id"]: (r["n_removed"], r["longest"]) for r in sub.dedup(docs_of(spark, texts), maximal=True).collect()}
    assert got == {1: (0, 0)} | {i: (200, 104) for i in range(2, 9)}
    assert rows["level"] == 0 and rows["stretches"] == 8 and rows["kinds"] == 1


def test_written_steps_free_their_shuffles(spark):
    from strata.session import free_shuffles

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with free_shuffles(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == before
    assert sub._written(spark.range(50).groupBy("id").count(), "few").count() == 50


def test_anchors_and_windows_move_once(spark, monkeypatch):
    calls, seen = [], sub._seen
    monkeypatch.setattr(sub, "_seen", lambda *a: calls.append(1) or seen(*a))
    docs = docs_of(spark, {i: [f"w{k}" for k in range(i, 60)] for i in range(1, 6)})
    found = sub._written(sub.candidates(docs, sub._copies(sub.plain_rows(docs), sub.WINDOW), sub.WINDOW, sub.ANCHOR), "found")
    assert len(calls) == 1
    plan = sub._survivors(sub._windows(found))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_one_block_sends_few_rows_of_a_common_passage(spark):
    passage = [f"p{i}" for i in range(40)]
    docs = docs_of(spark, {i: [f"a{i}", *passage, f"b{i}"] for i in range(1, 301)}).coalesce(1)
    seen = sub._seen(docs, sub.WINDOW, sub.ANCHOR).groupBy("h").agg(F.count("*").alias("n"), F.count("id").alias("unknown")).collect()
    assert max(r["n"] for r in seen) == 300 and max(r["unknown"] for r in seen) == 2
    found = sub._written(sub.candidates(docs, sub._copies(sub.plain_rows(docs), sub.WINDOW), sub.WINDOW, sub.ANCHOR).coalesce(1), "found")
    sent = sub._windows(found).groupBy("dig").agg(F.count("*").alias("n"), F.count("hit").alias("known")).collect()
    assert max(r["n"] for r in sent) == 300 and max(r["n"] - r["known"] for r in sent) == 2


def test_hits_do_not_hang_on_what_is_looked_at_together(spark, monkeypatch):
    rnd, base = random.Random(11), [f"w{i}" for i in range(120)] + ["x"] * 30
    rows = [(rnd.choice([None, i % 17, i]), " ".join([f"own{i}", *base[(a := rnd.randrange(140)):a + 40]])) for i in range(60)]
    got = []
    for parts, together in ((1, sub.TOGETHER), (7, sub.TOGETHER), (3, 1)):
        monkeypatch.setattr(sub, "TOGETHER", together)
        docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string").repartition(parts)
        got.append(sorted(map(str, sub.dedup(docs, maximal=True).collect())))
    assert got[0] == got[1] == got[2]
    ids = [sub.NO_ID if i is None else i for i, _ in rows]
    first = {}
    for i, (_, t) in zip(ids, rows, strict=True):
        ws = t.split()
        for k in range(len(ws) - 12):
            g = tuple(ws[k:k + 13])
            first[g] = min(first.get(g, i), i)
    want = []
    for i, (doc_id, t) in zip(ids, rows, strict=True):
        ws, gone = t.split(), set()
        for k in range(len(ws) - 12):
            if first[tuple(ws[k:k + 13])] < i:
                gone |= set(range(k, k + 13))
        want.append((str(doc_id), len(ws), len(gone)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in sub.dedup(docs).collect()) == sorted(want + want[:9])


def test_sums_of_neighbours_are_as_one_by_one():
    h = np.random.default_rng(3).integers(0, 1 << 63, 90).astype(np.uint64)
    for k in range(4, 20):
        slow = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            slow = slow * arrays._M1 + h[i:i + len(slow)]
        assert (arrays._rolled(h, k) == slow).all()
        assert (sub._lowest(h, k) == [h[i:i + k].min() for i in range(len(slow))]).all()
