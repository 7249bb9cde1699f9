import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge_dir(tmp_path_factory, spark):
    """A folder of tables like the drivers', documents awkward."""
    d = tmp_path_factory.mktemp("edge")
    spark.createDataFrame(brute.texts(), brute.DOCS).repartition(3).write.parquet(f"file://{d}/documents.parquet")
    ids = [1, 2, 3, 11, 16, 14, None]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array([1, 1, 0, 1, 1, 1, 0], pa.int64()),
                             "toxic": pa.array([0, 0, 0, 0, 1, None, 0], pa.int64())}), f"{d}/labels.parquet")
    pages = [(1, "http://a/\r\nX: y", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", None), (4, "http://d", ""),
             (None, "http://e", "<p>x</p>"), (5, "http://f", "only"), (5, "http://f", "only"), (None, None, "alone é")]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr(
        "*", "1 as strong", "2 as key", "'k' as payload").write.parquet(f"file://{d}/pages.parquet")
    items = [(1, f"{brute.PASSAGE} nobody"), (2, None), (3, ""), (None, "the éà 漢字 STRASSE idiot"), (4, "two words"),
             (4, "two words"), (4, "one and the same"), (5, "🙂 x" + " xx" * 3000)]
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as q", "2 as row", "'t' as term") \
        .write.parquet(f"file://{d}/benchmark.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory, spark):
    d = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], brute.DOCS).write.parquet(f"file://{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"file://{d}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"file://{d}/pages.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{d}/benchmark.parquet")
    return str(d)


def rows_of(spark, d):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
