"""Scalar expressions against the standard library (parity by rule)."""

import html
import urllib.parse as up

from pyspark.sql import functions as F

from strata.functions.charset import decode_bodies, first_decoding
from strata.functions.records import archive_stem, guess_extension, redact_headers
from strata.functions.text import collapse_ws, parse_amount, unescape
from strata.functions.urls import base_struct, build_url, iri_to_uri, query_map, query_param, resolve_array, resolve_url

BASES = ["http://a.com/b/c/d;p?q#f", "https://h.example.org/dir/", "http://h.com", "http://h.com/x.html?a=1",
         "HTTP://H.com/a/"]
HREFS = ["g", "./g", "g/", "/g", "//g/x", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..",
         "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g",
         "./g/.", "g/./h", "g/../h", "g;x=1/./y", "mailto:a@b", "https://other/x", "http:g", "  /sp  ", "a//b",
         "/a//b/../c", "#", "?", "/für", "~u", "*", "/g?", "/g#", "HTTP://X/y", "http://other/./x"]


def test_resolve_url_matches_urljoin(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "b string, h string")
    got = df.select("b", "h", resolve_url("b", "h").alias("r")).collect()
    bad = [(r.b, r.h, r.r, up.urljoin(r.b, r.h.strip())) for r in got if r.r != up.urljoin(r.b, r.h.strip())]
    assert not bad


def test_resolve_array_fast_and_general_paths(spark):
    df = spark.createDataFrame([(b, [h.strip() for h in HREFS if h.strip()]) for b in BASES] +
                               [(b, ["/ok", "/x?y#z"]) for b in BASES], "b string, hs array<string>")
    for r in df.select("b", "hs", resolve_array(base_struct("b"), F.col("hs")).alias("r")).collect():
        assert r.r == [up.urljoin(r.b, h) for h in r.hs]


def test_iri_to_uri_matches_quote(spark):
    urls = ["http://h.com/für dich?q=ä b&x=~*+%2F#frag ment", "https://x.org/a%20b/~c*d?k=v:1/2?+&y=%",
            "http://h/p", "https://例子.测试/路径?城市=北京"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    for r in df.select("u", iri_to_uri("u").alias("o")).collect():
        p = up.urlsplit(r.u)
        exp = up.urlunsplit((p.scheme, p.netloc, up.quote(p.path, safe="/%"), up.quote(p.query, safe="=&?/%:+"),
                             up.quote(p.fragment, safe="")))
        assert r.o == exp


def test_query_params_and_build_url(spark):
    df = spark.createDataFrame([("http://x/monthdata.php?city=%E5%8C%97%E4%BA%AC&month=202401&e=",)], "u string")
    r = df.select(query_param("u", "city").alias("c"), query_param("u", "missing").alias("m"),
                  query_map("u").alias("qm")).first()
    assert r.c == "北京" and r.m == "" and r.qm == {"city": "北京", "month": "202401", "e": ""}
    b = df.select(build_url(F.lit("https://api/h"), {"city": F.lit("北 京"), "n": 3}).alias("b")).first().b
    assert b == "https://api/h?" + up.urlencode({"city": "北 京", "n": 3})


def test_unescape_matches_stdlib_for_supported_entities(spark):
    texts = ["a &amp; b &lt;c&gt; &#233;&#x4E2D; &amp;lt; &nbsp;x &bogus; & &#0; &copy;", "no entity", "&amp;&amp;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", unescape("t").alias("u")).collect():
        assert r.u == html.unescape(r.t)


def test_collapse_ws_is_unicode_aware(spark):
    r = spark.createDataFrame([("  a 　b\t\n c  ",)], "t string").select(collapse_ws("t").alias("c")).first()
    assert r.c == "a b c"


def test_parse_amount(spark):
    df = spark.createDataFrame([("¥1,200/件",), ("abc",), ("-5.5 USD",), ("350万",), (None,)], "t string")
    got = [tuple(r) for r in df.select(parse_amount("t").alias("a")).select("a.*").collect()]
    from decimal import Decimal
    assert got[0] == (Decimal("1200.00"), "¥", "件")
    assert got[1] == (None, None, None)
    assert got[2][0] == Decimal("-5.50") and got[2][1] == "USD"
    assert got[3][0] == Decimal("3500000.00")
    assert got[4] == (None, None, None)


def test_headers_extension_and_redaction(spark):
    df = spark.createDataFrame([({"Content-Type": "application/JSON", "Set-Cookie": "a", "AUTHORIZATION": "b", "X": "c"},),
                                ({"content-type": "text/plain"},), ({},)], "h map<string,string>")
    rows = df.select(guess_extension("h").alias("e"), redact_headers("h").alias("r")).collect()
    assert [r.e for r in rows] == [".json", ".txt", ".html"]
    assert rows[0].r == {"Content-Type": "application/JSON", "Set-Cookie": "[redacted]", "AUTHORIZATION": "[redacted]", "X": "c"}


def test_archive_stem(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05", "abcdef0123456789ffff")], "t string, h string")
    r = df.select(archive_stem(F.col("t").cast("timestamp"), "h").alias("s")).first()
    assert r.s == "2024-01-02T030405Z0000_abcdef0123456789"


def test_decode_bodies_candidate_chain(spark):
    zh = "中文页面，价格1200元。"
    rows = [(1, zh.encode("utf-8"), {"Content-Type": "text/html; charset=utf-8"}),
            (2, zh.encode("gb18030"), {"Content-Type": "text/html; charset=GB18030"}),
            (3, ("<meta charset='gbk'>" + zh).encode("gbk"), {}),
            (4, zh.encode("gb18030"), {}),
            (5, zh.encode("gb18030"), {"content-type": "text/html; charset=utf-8"}),
            (6, b"a\xffb\xfe", {}),
            (7, zh.encode("utf-16"), {"Content-Type": "text/html; charset=utf-16"}),
            (8, None, {})]
    df = spark.createDataFrame(rows, "id int, body binary, headers map<string,string>")
    got = {r.id: r.text for r in decode_bodies(df).collect()}
    want = {1: zh, 2: zh, 3: "<meta charset='gbk'>" + zh, 4: zh, 5: zh, 6: "a\ufffdb\ufffd", 7: zh, 8: None}
    assert got == want
    assert first_decoding(zh.encode("gb18030"), ["utf-8", "gb18030"]) == zh
