"""What the second review found missing."""

from __future__ import annotations

from strata.llm import pii, simhash
from tests.llm import brute


def _text(seed: int, n: int = 60) -> str:
    return " ".join(f"w{seed}x{(seed * 31 + i * i) % 997}" for i in range(n))


def test_keep_first_goes_by_row_not_by_id(spark):
    copied, other = _text(1), [_text(k) for k in range(2, 8)]
    rows = [(1, copied), (None, copied), (None, other[0]), (None, other[1]), (18, copied), (18, other[2]), (18, other[3]),
            (18, other[3]), (7, other[4]), (None, None), (-(1 << 63), other[5]), (-(1 << 63), copied)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, simhash.keep_first(docs).collect()), key=str)
    assert len({brute.fingerprint(t) for _, t in rows}) == 8
    low = -(1 << 63)
    want = [(None, other[0]), (None, other[1]), (18, other[2]), (18, other[3]), (18, other[3]), (7, other[4]),
            (None, None), (low, other[5]), (low, copied)]
    assert got == sorted(want, key=str)


def test_field_runs_without_pattern_spans(spark):
    long = "a" * 90
    rows = [(1, "write bob (at) example (dot) com or bob (at) example (dot) com"),
            (2, "ring 1 (017) 555-7713, yes 1 (017) 555-7713"),
            (3, f"{long} (at) example (dot) com, {long} (at) example (dot) com"), (4, "nothing here"), (None, None)]
    mails = [f"{'abcdefgh'[i % 8]}{'klmnopqr'[i // 8]}@example.com" for i in range(60)]
    more = [(100 + i, f"mail {m}, call +1 ({100 + i}) 555-{1000 + 7 * i}, again {m} and +1 ({100 + i}) 555-{1000 + 7 * i}")
            for i, m in enumerate(mails)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string")
    field = pii.train(docs)
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs, field).collect()}
    assert got[1] == "email:6:32,email:36:62" and got[2] == "phone:5:21,phone:27:43"
    assert got[3] == "email:0:113,email:115:228" and got[4] == got[None] == ""
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs, field).collect()}
    assert masked[1] == "write [EMAIL] or [EMAIL]" and masked[2] == "ring [PHONE], yes [PHONE]"
    assert masked[3] == "[EMAIL], [EMAIL]" and masked[4] == "nothing here" and masked[None] is None


def test_counts_cover_texts_with_marks_only(spark):
    docs = spark.createDataFrame([(1, "bob [at] example [dot] com"), (2, "bob (at) example")], "doc_id long, text string")
    assert {(r["what"], r["b"], r["n"]) for r in pii.gather(docs).collect()} == {("shape", 0, 2)}
