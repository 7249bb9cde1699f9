"""Rows that once crashed, multiplied or vanished."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from strata.functions import urls as U
from strata.operators import columns as C
from strata.operators import filters as FL
from strata.operators import joins as J
from strata.operators import quality as Q
from strata.operators import windows as W
from strata.plans import flows


def _archive(spark, bodies):
    rows = [(f"raw/{k}", f"http://h/{i}", {"Content-Type": "text/html; charset=utf-8"}, b) for i, (k, b) in enumerate(bodies)]
    return spark.createDataFrame(rows, "raw_file_path string, source_url string, headers map<string,string>, body binary")


def test_equal_bodies_give_one_record_each(spark):
    arch = _archive(spark, [("a", b""), ("a", b""), ("a", b""), ("b", b"<h1>x</h1>"), ("b", b"<h1>x</h1>"), ("c", None)])
    for fields in (None, {"h": "h1::text"}):
        got = flows.extract_records(arch, fields).collect()
        assert sorted(r["source_url"] for r in got) == [f"http://h/{i}" for i in range(6)]
    assert [r["h"] for r in sorted(got, key=lambda r: r["source_url"])] == ["[]"] * 3 + ["x", "x"] + ["[]"]


def test_bad_selectors_never_fail(spark):
    got = flows.extract_records(_archive(spark, [("a", b""), ("b", b"<p>x")]), {"b": "a:hover", "c": "a:visited"}).collect()
    assert len(got) == 2 and all(r["b"] == "" and len(r["extraction_errors"]) >= 2 for r in got)


def test_one_record_per_request(spark):
    t = dt.datetime(2024, 1, 1)
    rec = spark.createDataFrame([("u", 500, t, "x"), ("u", 200, t, "b"), ("u", 200, t, "a")],
                                "source_url string, status_code int, fetched_at timestamp, content_hash string")
    urls = spark.createDataFrame([(1, "u"), (2, "v")], "seq int, url string")
    got = [r for r in J.batch_extract(urls, rec).collect()]
    assert [(r["source_url"], r["row_kind"]) for r in sorted(got, key=lambda r: r["seq"])] == [("u", 0), ("v", 1)]
    winners = {W.latest_attempt(rec.repartition(n).orderBy(F.rand(n)), "source_url").first()["content_hash"] for n in (1, 2, 3)}
    assert len(winners) == 1


def test_query_map_repeats_and_bad_escapes(spark):
    df = spark.createDataFrame([("http://h/?a=1&b=2&a=3&c=%zz",)], "u string")
    assert df.select(U.query_map("u").alias("m")).first()["m"] == {"b": "2", "a": "3", "c": "%zz"}
    assert df.select(U.query_param("u", "c").alias("c")).first()["c"] == "%zz"


def test_masks(spark):
    text = "2024-01-15 order 123456789 Cookie: sid=abc123\ncall +86 138 0013 8000 or (010) 6552 9988"
    out = spark.createDataFrame([(text,)], "t string").select(C.mask_text(F.col("t")).alias("t")).first()["t"]
    assert "2024-01-15 order 123456789" in out and "abc123" not in out and "8000" not in out and "9988" not in out


def test_null_fields_stay_in_json(spark):
    df = spark.createDataFrame([((1, None),)], "s struct<a:int,b:string>")
    assert C.flatten_nested(df).first()["s"] == '{"a":1,"b":null}'


def test_exact_quartiles_and_median(spark):
    rng = np.random.default_rng(1)
    rows = [(c, float(v)) for c, n in (("a", 1000), ("b", 7), ("c", 1)) for v in rng.normal(0, 5, n)] + [(None, 1.0), ("a", None)]
    got = {r["__cat"]: (r["q1"], r["q3"]) for r in FL.exact_quantiles(
        spark.createDataFrame(rows, "c string, v double"), "v", "c", {"q1": 0.25, "q3": 0.75}).collect()}
    for c in ("a", "b", "c", None):
        v = sorted(x for k, x in rows if k == c and x is not None)
        assert got[c] == tuple(v[int(np.ceil(len(v) * p)) - 1] for p in (0.25, 0.75))
    df = spark.createDataFrame([(i, "x" * n, 1) for i, n in enumerate((5, 1, 9, 3))], "k int, t string, p int")
    assert Q.row_unit_check(df, "k", "t", "p").first()["median_chars"] == 3
