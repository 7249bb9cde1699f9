"""Streaming jobs over a folder that grows between AvailableNow runs."""

import datetime as dt

from pyspark.sql import types as T

from strata.session import scratch_path
from strata.streaming import jobs as S

SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("h", T.StringType()),
                       T.StructField("status", T.StringType()), T.StructField("ts", T.TimestampType())])


def _write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _t(h, m=0):
    return dt.datetime(2024, 1, 1, h, m)


def _drain(spark, df, sink, ck, mode="append"):
    S.run_to_table(df, sink, ck, mode)
    return spark.read.parquet(sink)


def test_health_drops_late_rows_and_keeps_last_window_open(spark):
    src_dir, sink, ck = scratch_path(spark, "src"), scratch_path(spark, "sink"), scratch_path(spark, "ck")
    _write(spark, src_dir, [("u", "a", "200", _t(0, 10)), ("u", "a", "500", _t(0, 20)), ("u", "a", "200", _t(3, 5))])
    stream = lambda: S.stream_health(spark.readStream.schema(SCHEMA).parquet(src_dir), "ts", "status")
    out = _drain(spark, stream(), sink, ck)
    got = sorted((r.window.start.hour, r.status, r.n) for r in out.collect())
    assert got == [(0, "200", 1), (0, "500", 1)]  # window 03:00 still open
    # a late row for hour 0 (behind the 02:05 watermark) is dropped; time moves on
    _write(spark, src_dir, [("u", "a", "200", _t(0, 30)), ("u", "a", "200", _t(6, 0))])
    out = _drain(spark, stream(), sink, ck)
    got = sorted((r.window.start.hour, r.status, r.n) for r in out.collect())
    assert got == [(0, "200", 1), (0, "500", 1), (3, "200", 1)]


def test_archive_ingest_resumes_without_duplicates(spark):
    src_dir, sink, ck = scratch_path(spark, "src"), scratch_path(spark, "sink"), scratch_path(spark, "ck")
    _write(spark, src_dir, [("u1", "a", "200", _t(1))])
    S.stream_archive(spark, src_dir, SCHEMA, sink, ck).awaitTermination()
    _write(spark, src_dir, [("u2", "b", "200", _t(2))])
    S.stream_archive(spark, src_dir, SCHEMA, sink, ck).awaitTermination()
    S.stream_archive(spark, src_dir, SCHEMA, sink, ck).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(sink).collect()) == ["u1", "u2"]


def test_dedup_and_changes_across_batches(spark):
    src_dir = scratch_path(spark, "src")
    sink_d, ck_d = scratch_path(spark, "sink"), scratch_path(spark, "ck")
    sink_c, ck_c = scratch_path(spark, "sink"), scratch_path(spark, "ck")
    dedup = lambda: S.stream_dedup(spark.readStream.schema(SCHEMA).parquet(src_dir), "ts", ["url", "h"])
    changes = lambda: S.stream_changes(spark.readStream.schema(SCHEMA).parquet(src_dir), "url", "ts", "h")
    _write(spark, src_dir, [("u1", "a", "200", _t(1)), ("u1", "a", "200", _t(1, 5)), ("u1", "b", "200", _t(1, 10))])
    _drain(spark, dedup(), sink_d, ck_d)
    with S.rocksdb_state(spark):
        _drain(spark, changes(), sink_c, ck_c)
    _write(spark, src_dir, [("u1", "b", "200", _t(1, 20)), ("u1", "a", "200", _t(1, 30))])
    d = _drain(spark, dedup(), sink_d, ck_d)
    with S.rocksdb_state(spark):
        c = _drain(spark, changes(), sink_c, ck_c)
    # (u1, b) re-fetched within the watermark is dropped; (u1, a) is still in state as well
    assert sorted((r.url, r.h) for r in d.collect()) == [("u1", "a"), ("u1", "b")]
    # state carries the last hash across batches: a -> b (changed), b -> b (no row), b -> a (changed)
    got = sorted((r.ts.minute, r.change, r.prev_hash) for r in c.collect())
    assert got == [(0, "new", None), (10, "changed", "a"), (30, "changed", "b")]


def test_late_rows_change_nothing(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    src_dir, sink, ck = scratch_path(spark, "src"), scratch_path(spark, "sink"), scratch_path(spark, "ck")
    for rows in ([("u", "a", "200", _t(5)), ("n", None, "200", _t(5))], [("u", "b", "200", _t(1))],
                 [("u", "a", "200", _t(6)), ("u", "c", "200", _t(2)), ("v", "a", "200", _t(1))]):
        _write(spark, src_dir, rows)
        with S.rocksdb_state(spark):
            out = _drain(spark, S.stream_changes(spark.readStream.schema(SCHEMA).parquet(src_dir), "url", "ts", "h"), sink, ck)
    assert sorted((r.entity, r.ts.hour, r.change) for r in out.collect()) == [("u", 5, "new"), ("v", 1, "new")]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_entities_unseen_for_long_are_new_again(spark):
    """State ends by the stream's own time: 'gone' and 'late' were last seen 30 days before the newest row."""
    src_dir, sink, ck = scratch_path(spark, "src"), scratch_path(spark, "sink"), scratch_path(spark, "ck")
    at = lambda m, d: dt.datetime(2024, m, d)
    job = lambda: S.stream_changes(spark.readStream.schema(SCHEMA).parquet(src_dir), "url", "ts", "h")
    for rows in ([("gone", "a", "200", at(1, 1)), ("kept", "a", "200", at(1, 1)), ("late", "a", "200", at(1, 1))],
                 [("kept", "a", "200", at(1, 25)), ("other", "a", "200", at(2, 5))],
                 [("gone", "a", "200", at(2, 6)), ("kept", "b", "200", at(2, 6)), ("late", "b", "200", at(1, 3))],
                 [("gone", "b", "200", at(2, 7))]):
        _write(spark, src_dir, rows)
        with S.rocksdb_state(spark):
            out = _drain(spark, job(), sink, ck)
    got = sorted((r.entity, r.ts.month, r.ts.day, r.change, r.prev_hash) for r in out.collect() if r.entity != "other")
    assert got == [("gone", 1, 1, "new", None), ("gone", 2, 6, "new", None), ("gone", 2, 7, "changed", "a"),
                   ("kept", 1, 1, "new", None), ("kept", 2, 6, "changed", "a"), ("late", 1, 1, "new", None)]


def test_change_detector_loads_without_the_package(tmp_path):
    import subprocess
    import sys
    from pyspark import cloudpickle
    file = tmp_path / "detector.pkl"
    file.write_bytes(cloudpickle.dumps(S.ChangeDetector(None)))
    code = f"import pickle, sys; d = pickle.load(open({str(file)!r}, 'rb')); assert d.ttl_ms is None and 'strata' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})


class _Held:
    """State and timers of one entity, kept here."""

    def __init__(self):
        self.value, self.timers = None, []

    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value

    def getValueState(self, *args):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


def test_change_detector_takes_plain_rows_and_gives_one_an_entity():
    from pyspark.sql import Row
    held = _Held()
    d = S.ChangeDetector(None, expires=True)
    d.init(held)
    obs = lambda *rows: iter([Row(at=a, tiebreak=t, content_hash=h) for a, t, h in rows])
    out = list(d.handleInputRows(("e",), obs((3000, 1, "b"), (1000, 1, "a"), (2000, 1, "a")), held))
    assert out == [Row(entity="e", at=[1000, 3000], hashes=["a", "b"], known=None)]
    assert held.value == ("b", 3000, 1) and held.timers == [3]
    # the same time with no tiebreak comes last; an earlier row is late
    out = list(d.handleInputRows(("e",), obs((2500, 9, "z"), (3000, None, "c")), held))
    assert out == [Row(entity="e", at=[3000], hashes=["c"], known="b")]
    assert held.value == ("c", 3000, None) and held.timers == [3]
    assert not list(d.handleInputRows(("e",), obs((3000, 5, "q")), held))
