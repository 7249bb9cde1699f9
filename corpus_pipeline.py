"""The corpus pipeline: five stages over ``documents``, each an operator of
``strata.llm`` whose decisions take effect. Every stage's rows are written as
Parquet to the shared scratch folder and read again by the next.

1. quality rules: documents that fail the rules or the classifier go;
2. SimHash near-duplicates: of each group the document with the smallest
   ``doc_id`` stays;
3. substring dedup: words of passages that an earlier document has go;
4. personal data: spans are replaced by their kind in brackets;
5. best-fit packing: one row per piece and its place in a sequence.

Stages 1 to 4 return the columns of ``documents`` (``n_chars`` follows a
changed text). Edge cases are those of the operators; a document whose
``doc_id`` is null stays in stage 2 unless its group has one that is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import packing, pii, quality, simhash, substrings
from strata.llm.queries import tokenizer
from strata.session import scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    heads = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, heads)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("SimHash near-duplicates", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("personal data", mask_personal_data),
    ("best-fit packing", pack),
]

#: The classifier, the random field and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline") + "/" + name.replace(" ", "-")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
