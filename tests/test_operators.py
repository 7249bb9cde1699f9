"""Operators on hand-made edge rows (FIXTURES part C)."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.operators import columns as C
from strata.operators import joins as J
from strata.operators import links as LK
from strata.operators import quality as Q
from strata.operators import windows as W
from strata.sources.api import observations_from_api, parse_api_documents

PAGE = ('<html><body><a href="/a">A</a><a href="/b">B</a><a href="/a">A2</a>'
        '<A HREF=\'/c?x=1&amp;y=2\'>C</A><a href="mailto:x@y">M</a><a href="">E</a></body></html>')


def test_links_first_seen_cap_then_filter(spark):
    df = spark.createDataFrame([(1, "http://h.com/p/q", PAGE)], "page_id long, url string, html string")
    got = [r.link for r in LK.discover_links(df).orderBy("pos").collect()]
    assert got == ["http://h.com/a", "http://h.com/b", "http://h.com/c?x=1&y=2", "mailto:x@y"]
    capped = [r.link for r in LK.discover_links(df, max_links=2, deny="/b$").orderBy("pos").collect()]
    assert capped == ["http://h.com/a"]  # cap first, then filter: fewer than the cap remain
    assert LK.discover_links(df, max_links=0).count() == 0


def test_is_missing_and_has_error(spark):
    df = spark.createDataFrame(
        [(None, None, None), ("", [], "x"), ("[]", ["e"], None), ("ok", [], None)],
        "a string, extraction_errors array<string>, error string")
    rows = df.select(Q.is_missing(df, "a").alias("m"), Q.has_error(df).alias("e"),
                     Q.has_error(df, ["extraction_errors", "error"]).alias("e2")).collect()
    assert [r.m for r in rows] == [True, True, False, False]
    assert [r.e for r in rows] == [False, True, True, False]  # 'error' is looked at first
    # first present error field decides; an empty list found first hides later fields
    assert [r.e2 for r in rows] == [False, False, True, False]


def test_missing_values_empty_table(spark):
    df = spark.createDataFrame([], "a string, b array<string>")
    rows = {r.field: (r.missing, r.rate) for r in Q.missing_values(df).collect()}
    assert rows == {"a": (0, 0.0), "b": (0, 0.0)}


def test_duplicates_and_notes(spark):
    df = spark.createDataFrame([("e1", "h", 200, None), ("e1", "h", 200, None), ("e1", "h2", None, None),
                                ("", "h2", 404, "boom")],
                               "entity_id string, content_hash string, status_code int, error string")
    s = Q.record_summary(df).first()
    assert (s.records, s.fields, s.duplicate_entity_ids, s.shared_hash_rows, s.error_records) == (4, 4, 2, 2, 1)
    status = {r.status: r.n for r in Q.status_distribution(df).collect()}
    assert status == {"200": 2, "missing": 1, "404": 1}
    notes = [r.note for r in Q.quality_notes(Q.record_summary(df)).orderBy("rule").collect()]
    assert notes == ["errors", "duplicate_ids", "shared_hashes"]


def test_api_documents_edge_cases(spark):
    docs = [
        ('{"success": true, "result": {"data": {"items": [{"time_point": "2024-01-01", "aqi": 50}]}}}',),
        ('{"success": "true", "result": {"data": {"items": [{"time_point": "2024-01-01"}]}}}',),
        ('{"success": true, "result": {"data": {"items": []}}}',),
        ('{"success": true, "result": {"data": {}}}',),
        ('{"success": true, "result": {"data": {"items": "x"}}}',),
        ('{"success": true, "result": "oops"}',),
        ('{"success": false, "errmsg": "denied"}',),
    ]
    df = spark.createDataFrame([(i, d, "bj", "202401") for i, (d,) in enumerate(docs)], "i int, j string, city string, month string")
    out = observations_from_api(parse_api_documents(df, "j"), "doc", "city", "month", "city-api", keep=["i"]).orderBy("i").collect()
    assert len(out) == 7  # one item row + six placeholders
    assert out[0]["数据状态"] == "ok" and out[0]["AQI"] == "50" and out[0]["entity_id"] == "city-api:bj:2024-01-01"
    assert all(r["数据状态"] == "no_items" for r in out[1:])
    assert out[6]["extraction_errors"] == "denied" and out[1]["entity_id"] == "city-api:bj:202401:no_data"


def test_safe_names_rules():
    names = ["PM2.5", "城市", "1abc", "AQI", "aqi", "x" * 40, "x" * 40 + "y", "__", "a-b c"]
    got = [s for s, _ in C.safe_names(names)]
    assert got == ["pm2_5", "v2", "v3", "aqi", "aqi_1", "x" * 28, "x" * 28 + "_1", "v8", "a_b_c"]
    assert C.safe_names(["z" * 100])[0][1] == "z" * 80


def test_project_and_localize(spark):
    df = spark.createDataFrame([("e", "北京", "5", "x")], "entity_id string, `城市` string, AQI string, source_url string")
    p = C.project_columns(df, ["city", "aqi", "AQI", "wind"], provenance=["source_url"])
    assert p.columns == ["城市", "AQI", "wind", "source_url"]
    assert p.first()["wind"] == ""
    assert C.localize_columns(p, "en").columns == ["city", "aqi", "wind", "source_url"]
    assert C.localize_columns(df, "auto").columns == ["实体ID", "城市", "AQI", "来源网址"]


def test_merge_extracted_keeps_provenance_and_errors(spark):
    meta = spark.createDataFrame([("u1", "h1", 0), ("u2", "h2", 10)], "source_url string, content_hash string, body_len int")
    ex = spark.createDataFrame([("u1", "T", "bad", ["f: x"]), ("u2", "T2", "h9", [])],
                               "source_url string, title string, content_hash string, extraction_errors array<string>")
    rows = {r.source_url: r for r in C.merge_extracted(meta, ex, "source_url", body_len="body_len").collect()}
    assert rows["u1"].content_hash == "h1" and rows["u1"].title == "T"
    assert rows["u1"].extraction_errors == ["f: x", "empty response body"]
    assert rows["u2"].extraction_errors is None
    wins = {r.source_url: r for r in C.merge_extracted(meta, ex, "source_url", extracted_wins=True).collect()}
    assert wins["u1"].content_hash == "bad"


def test_minimize_masks(spark):
    df = spark.createDataFrame([(1, "mail a.b@x.org, call +1 555-123-4567, token=abc123, Bearer xyz.123")], "id int, t string")
    t = C.minimize(df, ["id", "t"], ["t"]).first().t
    assert "a.b@x.org" not in t and "555-123-4567" not in t and "abc123" not in t and "xyz.123" not in t


def test_split_lag_equals_plain_window(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b"]), rnd.randint(0, 10_000), i, rnd.choice(["x", "y"])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, i long, u string")
    got = W.split_lag(df, "k", ["t", "i"], ["u", "t"], F.floor(F.col("t") / 700))
    w = Window.partitionBy("k").orderBy("t", "i")
    exp = df.select("*", F.lag("u").over(w).alias("prev_u"), F.lag("t").over(w).alias("prev_t"),
                    (F.row_number().over(w) > 1).alias("prev_exists"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))
    got_rn = W.split_row_number(df, "k", ["t", "i"], F.floor(F.col("t") / 500))
    exp_rn = df.withColumn("position", F.row_number().over(w).cast("long"))
    assert sorted(map(tuple, got_rn.collect())) == sorted(map(tuple, exp_rn.collect()))


def test_robots_longest_prefix(spark):
    urls = spark.createDataFrame([("https://h.com/a/b",), ("https://h.com/a/x",), ("https://h.com/z",),
                                  ("https://other.com/a",), ("https://h.com",)], "url string")
    rules = spark.createDataFrame([("h.com", "/a/", False), ("h.com", "/a/b", True), ("h.com", "/z", False),
                                   ("h.com", "/z", True)], "host string, prefix string, allow boolean")
    got = {r.url: r.allowed for r in J.robots_allowed(urls, rules).collect()}
    assert got == {"https://h.com/a/b": True, "https://h.com/a/x": False, "https://h.com/z": True,
                   "https://other.com/a": True, "https://h.com": True}


def test_missing_waves_and_changes(spark):
    df = spark.createDataFrame([("e", "2024-01-01 10:00:00", "h1"), ("e", "2024-01-03 09:00:00", "h1"),
                                ("e", "2024-01-04 09:00:00", "h2"), ("f", "2024-01-02 00:00:00", "h3")],
                               "e string, ts string, h string").withColumn("ts", F.col("ts").cast("timestamp"))
    mw = [(r.e, r.wave.day) for r in J.missing_waves(df, "e", "ts").collect()]
    assert mw == [("e", 2)]
    ch = {(r.e, r.wave.day): r.change for r in W.content_changes(df, "e", "ts", "h").collect()}
    assert ch == {("e", 1): "new", ("e", 3): "same", ("e", 4): "changed", ("f", 2): "new"}


def test_batch_extract_failures_follow_records(spark):
    urls = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u1")], "seq long, url string")
    recs = spark.createDataFrame([("u1", 404)], "source_url string, status_code int")
    out = J.batch_extract(urls, recs).orderBy("row_kind", "seq").collect()
    assert [(r.seq, r.row_kind, r.status_code, r.error) for r in out] == [
        (1, 0, 404, None), (3, 0, 404, None), (2, 1, None, "no archived response")]


def test_boilerplate_lines_and_flag_text(spark):
    from strata.operators import filters as FL
    rows = [(1, "h", "Menu\nReal text one\n© Site"), (2, "h", "Menu\nOther text\n© Site"),
            (3, "h", "Menu\n  © Site  "), (4, "h", "Solve the CAPTCHA to continue"),
            (5, "g", "Menu\nMenu")]
    df = spark.createDataFrame(rows, "id long, host string, text string")
    bp = {(r.host, r.line): (r.pages_with_line, r.pages) for r in FL.boilerplate_lines(df, "id", "host", "text").collect()}
    assert bp == {("h", "Menu"): (3, 4), ("h", "© Site"): (3, 4)}  # g has fewer than 3 pages
    flags = {r.id: (r.blocked, r.boilerplate_only) for r in FL.flag_text(df, "id", "host", None, "text").collect()}
    assert flags == {1: (False, False), 2: (False, False), 3: (False, True), 4: (True, False), 5: (False, False)}


def test_properties_on_driver_tables(spark):
    """failures + records = requested; status counts sum to the records."""
    import __spark_entry__ as E
    from conftest import SF_SMALL
    b = E.queries()["batch_extract"](spark, SF_SMALL)
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").count()
    links = E.queries()["discover_links"](spark, SF_SMALL).count()
    assert b.count() == pages + links
    st = E.queries()["status_distribution"](spark, SF_SMALL).agg(F.sum("n")).first()[0]
    assert st == E.queries()["record_summary"](spark, SF_SMALL).first().records
    fs = E.queries()["first_seen"](spark, SF_SMALL)
    assert W.first_seen(fs, "role", "turn", per="conv_id").count() == fs.count()  # idempotent


def test_flows_on_hand_written_archives(spark):
    from strata.plans import flows as FL
    from strata.session import scratch_path
    body = "<html><head><title>T</title></head><body><nav><a href='/d1'>1</a><a href='/d2'>2</a></nav></body></html>"
    detail = "<html><head><title>Detail</title></head><body><p>x</p></body></html>"
    arch = spark.createDataFrame([
        ("raw/a.html", "http://h.com/list", "http://h.com/list", 200, {"Content-Type": "text/html"}, body.encode()),
        ("raw/b.html", "http://h.com/d1", "http://h.com/d1", 404, {}, detail.encode()),
        ("raw/c.html", "http://h.com/e", "http://h.com/e", 200, {}, b"")],
        "raw_file_path string, source_url string, final_url string, status_code int, headers map<string,string>, body binary")
    recs = {r.raw_file_path: r for r in FL.extract_records(arch).collect()}
    assert recs["raw/a.html"].title == "T" and recs["raw/b.html"].text == "Detail\nx"
    assert recs["raw/c.html"].extraction_errors == ["empty response body"]
    listings = arch.filter("raw_file_path = 'raw/a.html'").select("source_url", "final_url", F.decode("body", "UTF-8").alias("html"))
    out = sorted((r.source_url, r.row_kind, r.status_code, r.listing_url) for r in
                 FL.listing_dataset(listings, arch.select("source_url", "status_code")).collect())
    assert out == [("http://h.com/d1", 0, 404, "http://h.com/list"), ("http://h.com/d2", 1, None, "http://h.com/list")]
    rep = FL.quality_report(FL.extract_records(arch))
    assert [r.status for r in rep["status"].collect()] == ["200", "404"]
    d = scratch_path(spark, "urls").replace("file:", "")
    import os
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/u.csv", "w") as fh:
        fh.write("url\nhttp://h.com/e\nhttp://h.com/missing\n")
    got = sorted((r.source_url, r.row_kind) for r in FL.url_list_dataset(spark, d, arch.select("source_url", "status_code")).collect())
    assert got == [("http://h.com/e", 0), ("http://h.com/missing", 1)]


def test_unit_changes_with_null_units(spark):
    df = spark.createDataFrame([("e", 1, None), ("e", 2, None), ("e", 3, "kg"), ("f", 1, "kg")],
                               "e string, t long, unit string")
    ts = df.withColumn("ts", F.timestamp_seconds(F.col("t") * 3600))
    got = {(r.e, r.t): r.unit_status for r in W.unit_changes(ts, "e", "ts", ["unit"]).collect()}
    assert got == {("e", 1): "new", ("e", 2): "same", ("e", 3): "changed", ("f", 1): "new"}
    lagged = W.split_lag(df, "e", ["t"], ["unit"], F.floor(F.col("t") / 2))
    rows = {(r.e, r.t): (r.prev_unit, r.prev_exists) for r in lagged.collect()}
    assert rows == {("e", 1): (None, False), ("e", 2): (None, True), ("e", 3): (None, True), ("f", 1): (None, False)}


def test_price_and_date_flags(spark):
    from strata.functions.text import parse_amount
    from strata.operators import filters as FL
    prices = [("a", f"¥{100 + i},00/件".replace(",00", "")) for i in range(12)] + \
             [("a", "abc"), ("a", "-5"), ("a", "¥1,200,000/件"), ("b", "¥7")]
    df = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(prices)], "id int, cat string, t string")
    df = df.withColumn("amount", parse_amount("t")["amount"].cast("double"))
    got = {r.id: (r.unparseable, r.negative, r.outlier) for r in FL.flag_price(df, "amount", "cat").collect()}
    assert got[12] == (True, False, False)          # 'abc'
    assert got[13] == (False, True, True)           # negative, and far below the quartiles
    assert got[14] == (False, False, True)          # extreme outlier
    assert got[15] == (False, False, False)         # category 'b' has too few rows to judge
    assert all(not any(v) for k, v in got.items() if k < 12)
    dates = spark.createDataFrame([(1, "2024-06-30"), (2, "2024-06-31"), (3, "2031-01-01"), (4, "1901-05-05"), (5, None)],
                                  "id int, d string")
    got = {r.id: (r.unparseable_date, r.future_date, r.too_old)
           for r in FL.flag_date(dates, "d", as_of="2025-01-01", fmt="yyyy-MM-dd").collect()}
    assert got == {1: (False, False, False), 2: (True, False, False), 3: (False, True, False),
                   4: (False, False, True), 5: (False, False, False)}


def test_conform_flags_bad_casts(spark):
    df = spark.createDataFrame([("e1", "12.5", "2024-01-01 10:00:00"), ("e2", "n/a", "bad")],
                               "entity_id string, `价格` string, observed_at string")
    rows = {r.entity_id: r for r in C.conform(df, "price").collect()}
    assert C.conform(df, "price").columns[:3] == ["entity_id", "observed_at", "商品名称"]
    assert float(rows["e1"]["价格"]) == 12.5 and rows["e1"].conform_errors == []
    assert rows["e2"]["价格"] is None and sorted(rows["e2"].conform_errors) == ["observed_at", "价格"]


def test_verify_archive_statuses(spark):
    from strata.functions.records import content_hash
    recs = spark.createDataFrame([("p1", b"a"), ("p2", b"b"), ("p3", b"c")], "raw_file_path string, body binary") \
        .withColumn("content_hash", content_hash("body")).drop("body")
    files = spark.createDataFrame([("p1", b"a"), ("p2", b"B"), ("p4", b"d")], "path string, content binary")
    got = {r.raw_file_path: r.status for r in J.verify_archive(recs, files).collect()}
    assert got == {"p1": "ok", "p2": "altered", "p3": "missing_file", "p4": "unrecorded"}


def test_fallback_short_page_boundary(spark):
    from strata.operators import filters as FL
    df = spark.createDataFrame([(1, "x" * 999, "day1", "month1"), (2, "x" * 1000, "day2", "month2")],
                               "id int, html string, meta string, month_meta string")
    got = {r.id: (r.used_fallback, r.meta) for r in FL.fallback_short_page(df, "html", ["meta"], ["month_meta"]).collect()}
    assert got == {1: (True, "month1"), 2: (False, "day2")}


def test_months_and_latest_month(spark):
    from strata.sources.api import extract_months
    pages = spark.createDataFrame([
        ("bj", "<a href='daydata.php?city=bj&month=202402'>x</a><a href=\"daydata.php?city=bj&month=202401\">"
               "<a href='daydata.php?city=bj&month=202402'>"),
        ("sh", "<a href='daydata.php?city=sh&amp;month=202403'>escaped separator</a>"),
        ("gz", "no links")], "city string, html string")
    months = {r.city: r.months for r in extract_months(pages, "html").collect()}
    assert months == {"bj": ["202401", "202402"], "sh": [], "gz": []}
    flat = extract_months(pages, "html").select("city", F.explode_outer("months").alias("m"))
    latest = {r.city: r.month for r in Q.latest_month(flat, "city", "m", as_of="2024-05-15").collect()}
    assert latest == {"bj": "202402", "sh": "202405", "gz": "202405"}  # none available -> month of as_of
    fixed = {r.city: r.month for r in Q.latest_month(flat, "city", "m", requested="202312").collect()}
    assert fixed == {"bj": "202312", "sh": "202312", "gz": "202312"}
    try:
        Q.latest_month(flat, "city", "m", requested="2023-12")
        raise AssertionError("malformed month must fail")
    except ValueError:
        pass


def test_panel_keeps_cities_without_documents(spark):
    import datetime as dt
    from strata.plans import panel as PN
    ev = spark.createDataFrame([(1, 7, dt.datetime(2024, 1, 5), "view", 1.0, '{"k": 3}'),
                                (2, 8, dt.datetime(2024, 2, 5), "view", 2.0, '{"k": 4}')],
                               "event_id long, user_id long, ts timestamp, event_type string, value double, props string")
    got = {r["城市"]: (r["数据状态"], r["extraction_errors"]) for r in PN.assemble_panel(ev, "202402").collect()}
    assert got == {"7": ("no_items", "API returned no day-level items"), "8": ("ok", None)}


def test_summary_counts_extra_rows(spark):
    from strata.operators import quality as Q
    df = spark.createDataFrame([("a", "h", None), ("a", "h", "x"), ("", "h", None), (None, None, ""), ("b", "", None)],
                               "entity_id string, content_hash string, error string")
    assert tuple(Q.record_summary(df).first()) == (5, 3, 1, 2, 1)
    assert tuple(Q.record_summary(df.limit(0)).first()) == (0, 3, 0, 0, 0)
