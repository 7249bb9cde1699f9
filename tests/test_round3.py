"""Rows keyed by content, ranks found by refinement, lines on every page."""

import hashlib
import html
import random
import statistics
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from strata.functions.text import unescape
from strata.operators import columns as C
from strata.operators import filters as FL
from strata.operators import joins as J
from strata.operators import windows as W
from strata.plans import flows
from strata.plans import panel as PN
from strata.schemas import API_PROVENANCE
from strata.session import scratch_path
from strata.sinks import writers as SK


def _archive(spark, rows):
    rows = [(p, u, t, {"Content-Type": "text/html; charset=utf-8"}, b) for p, u, t, b in rows]
    return spark.createDataFrame(rows, "raw_file_path string, source_url string, fetched_at string, headers map<string,string>, body binary")


@pytest.mark.parametrize("fields", [None, {"title": "title::text"}])
def test_records_keep_their_own_text_without_a_path(spark, fields):
    page = lambda k: f"<title>t{k}</title><p>{k}".encode()
    rows = [(None, "u1", None, page(1)), (None, "u2", None, page(2)), (None, None, None, page(3)), ("p", "u4", "t", page(4)),
            ("p", "u4", "t", page(5)), ("p", "u4", "t", None), ("p", "u4", "t", b"")] + [(None, "u6", "t", page(6))] * 7
    got = flows.extract_records(_archive(spark, rows).repartition(5), fields).collect()
    want = sorted((u or "", f"t{k}") for u, k in [("u1", 1), ("u2", 2), (None, 3), ("u4", 4), ("u4", 5)] + [("u6", 6)] * 7)
    titled = [r for r in got if r["title"] not in (None, "", "[]")]
    assert len(got) == len(rows) and sorted((r["source_url"] or "", r["title"]) for r in titled) == want
    ids = [r["record_id"] for r in got]
    assert len(set(ids)) == len(rows) and sorted(int(x[-1]) for x in ids) == [0] * 8 + [1, 2, 3, 4, 5, 6]
    again = flows.extract_records(_archive(spark, rows).repartition(2), fields).collect()
    assert sorted(ids) == sorted(r["record_id"] for r in again)


def test_merge_meets_rows_without_a_key(spark):
    meta = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)], "k string, n int")
    ex = spark.createDataFrame([(None, "x"), ("a", "y"), ("a", "y")], "k string, title string")
    got = sorted((r["n"], r["title"]) for r in C.merge_extracted(meta, ex, "k").collect())
    assert got == [(1, "x"), (2, "x"), (3, "y"), (4, None)]


@pytest.mark.parametrize("columns", [["status_code", "content_hash"], ["content_hash"], ["status_code"], ["fetched_at"], [],
                                     ["status_code", "fetched_at", "error"]])
def test_one_record_a_request_whatever_the_columns(spark, columns):
    attempts = spark.createDataFrame([("u", 500, "h1", 1, "e"), ("u", 200, "h2", 2, None), ("u", 200, "h3", 2, None), ("v", 200, "h", 3, None)],
                                     "source_url string, status_code int, content_hash string, fetched_at int, error string")
    recs = attempts.select("source_url", *columns)
    urls = spark.createDataFrame([(1, "u"), (2, "u"), (3, "w")], "seq int, url string")
    for n in (1, 3):
        got = sorted(J.batch_extract(urls, recs.repartition(n)).collect(), key=lambda r: r["seq"])
        assert [(r["seq"], r["row_kind"]) for r in got] == [(1, 0), (2, 0), (3, 1)]
        assert "status_code" not in columns or got[0]["status_code"] == 200
        assert "content_hash" not in columns or got[0]["content_hash"] == "h3"
    links = spark.createDataFrame([("u", "l")], "link string, listing_url string")
    assert J.listing_details(links, recs).count() == 1
    assert W.latest_attempt(recs).count() == 2


@pytest.mark.parametrize("few", [1, 1 << 16])
def test_quantiles_by_refinement(spark, monkeypatch, few):
    monkeypatch.setattr(FL, "FEW", few)
    far = [("a", 1e9), ("a", -1e300), ("a", 1e-300)] + [("a", 1.0 + k / 1000) for k in range(997)]
    odd = [("e", float("inf")), ("e", float("-inf"))] * 3 + [("e", 5.0), ("e", 1.7e308), ("e", -1.7e308)]
    rows = far + odd + [("b", 2.5)] * 40 + [(None, float(k % 7)) for k in range(30)] + [("c", None), ("d", -0.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "top": 1.0}
    got = {r["__cat"]: r for r in FL.exact_quantiles(df, "v", "g", shares).collect()}
    assert set(got) == {"a", "b", None, "d", "e"}
    for g in got:
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g]["__n"] == len(v)
        for name, q in shares.items():
            assert got[g][name] == v[max(1, -(-len(v) * q // 1).__int__()) - 1]
    assert statistics.median_low(x for g, x in far if g == "a") == got["a"]["q2"]
    cents = df.select("g", F.expr("try_cast(v as int)").alias("v")).where("v between 0 and 10")
    assert {r["__cat"] for r in FL.exact_quantiles(cents, "v", "g", {"q": 0.5}).collect()} == {"a", "b", None, "d", "e"}
    longs = spark.createDataFrame([("x", (1 << 60) + k) for k in range(9)], "g string, v long")
    assert FL.exact_quantiles(longs, "v", "g", {"q": 0.5}).first()["q"] == (1 << 60) + 4
    nan = spark.createDataFrame([("x", float("nan")), ("x", 1.0), ("x", 2.0)], "g string, v double")
    assert FL.exact_quantiles(nan, "v", "g", {"q": 0.5}).first()["q"] == 2.0


def test_one_far_value_leaves_no_heavy_range(spark, monkeypatch):
    """The range that holds the rank shrinks to one value although all others lie in one of its first parts."""
    monkeypatch.setattr(FL, "FEW", 50)
    df = spark.range(20_000).selectExpr("'x' as g", "case when id = 7 then 1e9 else 1 + id / 100000D end as v")
    got = FL.exact_quantiles(df, "v", "g", {"q1": 0.25, "q3": 0.75}).first()
    assert abs(got["q1"] - 1.05) < 1e-4 and abs(got["q3"] - 1.15) < 1e-4
    flags = FL.flag_price(df, "v", "g").groupBy("outlier").count().collect()
    assert {r["outlier"]: r["count"] for r in flags} == {False: 19_999, True: 1}


def _pages():
    menu = [(k, "big", f"Menu\nHome\nstory {k}" if k % 4 else "Menu\n  Home ") for k in range(400)]
    return menu + [(1000, "one", "Menu"), (1001, "two", "Menu"), (1002, "two", "Menu"), (1003, None, "Menu"), (1004, "big", None)]


@pytest.mark.parametrize("frequent", [1, 20_000])
def test_text_flags_say_what_was_judged(spark, monkeypatch, frequent):
    monkeypatch.setattr(FL, "MAX_FREQUENT", frequent)
    df = spark.createDataFrame(_pages(), "id long, host string, text string").repartition(6)
    given = spark.createDataFrame([("big", "Home"), ("big", "Menu"), ("one", "Menu")], "host string, line string")
    for lines in (None, given):
        got = {r["id"]: r for r in FL.flag_text(df, "id", "host", None, "text", lines).collect()}
        assert len(got) == 405
        assert [k for k in range(400) if got[k]["boilerplate_only"]] == list(range(0, 400, 4))
        assert {k: got[k]["judged"] for k in (0, 1000, 1001, 1002, 1003, 1004)} == {
            0: True, 1000: False, 1001: False, 1002: False, 1003: False, 1004: True}
        assert got[1000]["boilerplate_only"] == (lines is not None) and not got[1004]["boilerplate_only"]
    bp = {(r["host"], r["line"], r["pages_with_line"], r["pages"]) for r in FL.boilerplate_lines(df, "id", "host", "text").collect()}
    assert bp == {("big", "Menu", 400, 401), ("big", "Home", 400, 401)}


def test_a_line_on_every_page_spans_many_tasks(spark):
    """Without adaptive execution: the frequent line's rows stay where they are."""
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = spark.range(4000).repartition(6).selectExpr("'h' as grp", "id as key", "struct(1L as h1, 2 as h2) as lk")
        marked = lines.groupBy("grp", "lk").agg(F.count("*").alias("pages_with_line"))
        out = FL.mark_lines(lines, marked, 4000).select("is_bp", F.spark_partition_id().alias("p"))
        assert out.where("is_bp").count() == 4000 and out.select("p").distinct().count() >= 6
        pages = spark.createDataFrame([("h", 4000)], "grp string, pages long")
        spread = FL._with_pages(lines, pages, F.col("key")).select(F.spark_partition_id().alias("p"))
        assert spread.count() == 4000 and spread.distinct().count() >= 5
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_every_entity_as_the_standard_library_decodes_it(spark):
    """All names with and without a semicolon, before letters and signs, and numbers of all kinds."""
    rng = random.Random(2)
    texts = [f"a &{n}{tail}" for n in html5 for tail in ("", "x;", "=1&amp;lt;")]
    texts += [f"&#{z}{n}{e}x" for n in [*range(300), 0xD800, 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**9, 10**30] for z, e in (("", ";"), ("00", ""))]
    texts += [f"&#x{n:x}{e}g" for n in (0, 9, 13, 0x80, 0x9F, 0xA0, 0x1F600, 0xDFFF, 0x110000, 16**20) for e in ("", ";")]
    texts += ["".join(rng.choice(["&", "#", "x", ";", "amp", "not", "in", "copy", "é", " ", "9", "\t", "="]) for _ in range(12)) for _ in range(500)]
    texts += ["", "&", "&;", "&&", "no entity", "&" + "a" * 50 + ";", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["u"] for r in df.select("i", unescape("t").alias("u")).collect()}
    bad = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if t is not None and got[i] != html.unescape(t)]
    assert not bad, bad[:5]
    assert got[len(texts) - 1] is None


def test_a_batch_is_archived_once(spark, monkeypatch):
    path = scratch_path(spark, "archive")
    rows = lambda *ids: spark.createDataFrame(
        [(i, {"Cookie": "x"}, "2024-01-02 03:04:05", b"b") for i in ids], "id int, headers map<string,string>, fetched_at string, body binary")
    have = lambda: sorted(r["id"] for r in SK.read_archive_table(spark, path).collect())
    SK.write_archive(rows(1, 2), path, "2024")
    SK.write_archive(rows(1, 2), path, "2024")
    assert have() == [1, 2]
    write = type(rows(1).write).json
    monkeypatch.setattr(type(rows(1).write), "json", lambda *a, **b: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # killed between the data and the commit
        SK.write_archive(rows(3), path, "a/b =1")
    monkeypatch.setattr(type(rows(1).write), "json", write)
    assert have() == [1, 2]
    SK.write_archive(rows(3), path, "a/b =1")
    assert have() == [1, 2, 3]
    other = spark.createDataFrame([("2024", "a-0"), ("2024", "a-zz")], SK.COMMIT)  # two runs at once
    other.write.mode("append").json(f"{path}/commits")
    assert SK.archive_batches(spark, path).where("batch = '2024'").collect() == [("2024", "a-0")]
    assert SK.read_archive_table(spark, path).first()["headers"] == {"Cookie": "[redacted]"}


def test_a_publication_that_was_cut_off_does_not_count(spark, monkeypatch):
    root, df = scratch_path(spark, "publish"), spark.range(3)
    assert SK.publication(spark, root) is None
    out = SK.publish(df, root, None, ["jsonl", "csv"])
    assert SK.publication(spark, root) == out
    monkeypatch.setattr(SK, "write_csv", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        SK.publish(df, root, None, ["jsonl", "csv"])
    assert SK.publication(spark, root) is None


def test_panel_lineage_takes_the_month_page_where_the_day_page_is_short(spark):
    link = lambda c, *ms: "".join(f'<a href="daydata.php?city={c}&month={m}">' for m in ms)
    months = spark.createDataFrame(
        [(c, f"m/{c}", link(c, *ms), f"raw/m/{c}") for c, ms in
         {"long": ["202401", "202403"], "short": ["202402"], "none": ["202402"], "empty": ["202402"], "silent": ["202402"], "unlisted": []}.items()],
        "city string, url string, html string, raw_file_path string")
    page = "x" * 1000
    days = spark.createDataFrame(
        [("long", "202403", page), ("long", "202401", ""), ("short", "202402", page[1:]), ("empty", "202402", None),
         ("silent", "202402", page), ("unlisted", "202312", page)], "city string, month string, html string") \
        .selectExpr("*", "concat('d/', city, month) AS url", "concat('raw/d/', city, month) AS raw_file_path")
    body = '{"success": true, "result": {"data": {"items": [{"time_point": "2024-03-01"}, {"time_point": "2024-03-02"}]}}}'
    api = spark.createDataFrame([(c, m, body if c != "empty" else "not json") for c, m in
                                 [("long", "202403"), ("long", "202401"), ("short", "202402"), ("short", "202402"), ("none", "202402"),
                                  ("empty", "202402"), ("stranger", "202402")]], "city string, month string, body_text string") \
        .selectExpr("*", "concat('a/', city) AS source_url", "concat('a/', city) AS final_url", "timestamp'2024-03-05' AS fetched_at",
                    "200 AS status_code", "sha2(body_text, 256) AS content_hash", "concat('raw/a/', city) AS raw_file_path",
                    "concat('meta/', city) AS metadata_file_path")
    out = PN.panel_records(months, days, api, as_of="2023-12-15")
    assert set(API_PROVENANCE) <= set(out.columns)
    rows = {}
    for r in out.collect():
        rows.setdefault(r["城市"], []).append((r["月份"], r["数据状态"], r["page_raw_file_path"], r["used_fallback"], r["raw_file_path"]))
    assert rows == {
        "long": [("202403", "ok", "raw/d/long202403", False, "raw/a/long")] * 2,
        "short": [("202402", "ok", "raw/m/short", True, "raw/a/short")] * 4,
        "none": [("202402", "ok", "raw/m/none", True, "raw/a/none")] * 2,
        "empty": [("202402", "no_items", "raw/m/empty", True, "raw/a/empty")],
        "silent": [("202402", "no_items", "raw/d/silent202402", False, None)],
        "unlisted": [("202312", "no_items", "raw/d/unlisted202312", False, None)],
    }


def test_two_file_archive_reports_what_is_lost(spark):
    from strata.sources import archive as A
    root = scratch_path(spark, "files")
    meta = lambda url, body: '{"source_url": "%s", "content_hash": "%s"}' % (url, hashlib.sha256(body).hexdigest())
    rows = [("whole", b"<p>1</p>", meta("w", b"<p>1</p>")), ("empty", b"", meta("e", b"")), ("cut", b"<p", meta("c", b"<p>1</p>")),
            ("no body", None, meta("n", b"x")), ("no-sidecar", b"y", None), ("broken", b"z", '{"source_url": "b'), ("unhashed", b"u", '{"final_url": "u"}')]
    df = spark.createDataFrame([(s, {"Content-Type": "text/html"}, b, m) for s, b, m in rows],
                               "stem string, headers map<string,string>, body binary, meta string")
    A.write_archive_files(df, root + "/raw", root + "/meta")
    A.write_archive_files(df, root + "/raw", root + "/meta")  # the same files again
    got = {r["stem"]: (r["archive_status"], None if r["body"] is None else bytes(r["body"]))
           for r in A.read_archive_files(spark, root + "/raw", root + "/meta").collect()}
    want = {"whole": "ok", "empty": "ok", "cut": "partial", "no body": "no_body", "no-sidecar": "no_sidecar", "broken": "partial", "unhashed": "ok"}
    assert got == {s: (want[s], b) for s, b, _ in rows}
