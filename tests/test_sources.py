"""Readers and writers on hand-written files (fresh scratch folders)."""

import hashlib
import json
import os

from strata.session import scratch_path
from strata.sinks import writers as SK
from strata.sources.archive import read_archive
from strata.sources.files import read_records, read_url_list


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def test_url_list_bom_quotes_blanks_duplicates_limit(spark):
    d = _local(scratch_path(spark, "urls"))
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/list.csv", "w", encoding="utf-8-sig", newline="") as fh:
        fh.write('url,note\n" http://a/1 ","x, y"\n,blank\nhttp://a/2,"line\nbreak"\nhttp://a/1,dup\n')
    df = read_url_list(spark, d, "url")
    assert [r.url for r in df.orderBy("source_file", "seq").collect()] == ["http://a/1", "http://a/2", "http://a/1"]
    assert [r.url for r in read_url_list(spark, d, "url", limit=2).collect()] == ["http://a/1", "http://a/2"]
    assert read_url_list(spark, d, "url", limit=0).count() == 3
    try:
        read_url_list(spark, d, "link")
        raise AssertionError("missing column must fail")
    except ValueError:
        pass


def test_jsonl_and_csv_records(spark):
    d = scratch_path(spark, "rec")
    df = spark.createDataFrame([("a", None, 'q"uote, and\nnewline'), ("b", "x", "")], "k string, v string, t string")
    SK.write_jsonl(df, d + "/r.jsonl")
    back = {r.k: r for r in read_records(spark, d + "/r.jsonl", schema=df.schema).collect()}
    assert back["a"].v is None and back["a"].t == 'q"uote, and\nnewline'
    SK.write_csv(df, d + "/r.csv")
    back = {r.k: r for r in read_records(spark, d + "/r.csv").collect()}
    assert back["a"].t == 'q"uote, and\nnewline' and back["b"].v == "x"
    try:
        read_records(spark, d + "/r.xlsx")
        raise AssertionError("unknown suffix must fail")
    except ValueError:
        pass


def test_publish_rejects_unknown_format(spark):
    df = spark.createDataFrame([(1,)], "a int")
    try:
        SK.publish(df, scratch_path(spark, "p"), None, ["jsonl", "dta"])
        raise AssertionError("unknown format must fail")
    except ValueError:
        pass


def test_read_archive_joins_bodies_and_sidecars(spark):
    root = _local(scratch_path(spark, "archive"))
    os.makedirs(f"{root}/raw"), os.makedirs(f"{root}/meta")
    bodies = {"2024-01-01T000000Z0000_aaaa": b"<html>1</html>", "2024-01-01T000010Z0000_bbbb": "价格".encode("gb18030")}
    for stem, body in bodies.items():
        with open(f"{root}/raw/{stem}.html", "wb") as fh:
            fh.write(body)
        with open(f"{root}/meta/{stem}.json", "w", encoding="utf-8") as fh:
            json.dump({"source_url": "http://x/" + stem, "final_url": "http://x/" + stem,
                       "fetched_at": "2024-01-01T00:00:00+00:00", "status_code": 200,
                       "content_hash": hashlib.sha256(body).hexdigest(), "headers": {"Cookie": "[redacted]"},
                       "extractor_name": "urllib", "extractor_version": "0.1.1"}, fh, ensure_ascii=False, indent=2)
    df = read_archive(spark, f"{root}/raw", f"{root}/meta")
    rows = {r.stem: r for r in df.collect()}
    assert set(rows) == set(bodies)
    for stem, body in bodies.items():
        assert bytes(rows[stem].body) == body and rows[stem].status_code == 200
        assert rows[stem].content_hash == hashlib.sha256(body).hexdigest()


def test_csv_without_line_breaks_is_split(spark):
    from strata.sinks import writers as SK
    from strata.sources import files as SRC
    from strata.session import scratch_path
    path = SK.write_csv(spark.range(20_000).selectExpr("id", "concat('a, \"', id, '\"') t").coalesce(1),
                        scratch_path(spark, "csv") + "/r.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        parts = [SRC.read_records(spark, path, multiline=m) for m in (True, False)]
        assert parts[0].rdd.getNumPartitions() == 1 and parts[1].rdd.getNumPartitions() > 2
        assert sorted(parts[1].collect()) == sorted(parts[0].collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_publish_flattens_every_format(spark):
    from strata.sinks import writers as SK
    from strata.session import scratch_path
    df = spark.createDataFrame([(1, ["a", "b"], (1, None))], "k int, l array<string>, s struct<x:int,y:string>")
    root = scratch_path(spark, "publish")
    out = SK.publish(df, root + "/p", root + "/f", ["jsonl", "csv"])
    assert sorted(out) == ["csv", "final_csv", "final_jsonl", "jsonl"]
    want = ("1", '["a","b"]', '{"x":1,"y":null}')
    for p in (out["final_jsonl"], out["final_csv"]):
        row = (spark.read.json(p) if "json" in p else spark.read.option("header", True).option("escape", '"').csv(p)).first()
        assert (str(row["k"]), row["l"], row["s"]) == want
