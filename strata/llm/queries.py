"""The registered queries of the operators: ``QUERIES`` (name to a function of
(spark, sf_dir)) and ``ORACLE_SQL``. Each derives the columns of its contract
from its operator's results, over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, chunks, lbl, packing, phrases, pii, quality, search, sharding, simhash, substrings, token_files, warc
from strata.session import scratch_path


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op2_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return pii.find(docs, pii.train(docs))


def op3_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.fingerprint_documents(_documents(spark, sf_dir))


def op4_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("word_bpe_49k.json")
    done = bpe.decode_ids(bpe.encode_documents(_documents(spark, sf_dir), path), path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files") + "/files"
    token_files.write_token_files(_documents(spark, sf_dir), path, tokenizer("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path)


def op6_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")  # runs all levels


def op7_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc") + "/archive")
    return warc.read_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(_documents(spark, sf_dir))


#: The old layout of op11 and its new number of shards.
OLD_SHARDS, NEW_SHARDS = 16, 24


def op11_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _documents(spark, sf_dir), scratch_path(spark, "shards")
    old = sharding.table(spark, sharding.write_shards(docs, f"{path}/old", OLD_SHARDS, F.xxhash64("doc_id")), docs)
    folders, _ = sharding.reshard(old, NEW_SHARDS, f"{path}/moved")
    return sharding.resharded(old, folders, sharding.table(spark, f"{path}/moved", docs)).select(
        F.col("row.doc_id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_suffix_quicksort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir))


def op13_limited_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_skip_chain_crf, op3_content_chunks, op4_tree_bpe, op5_rans_files, op6_level_doubling,
    op7_ngram_quality, op8_multi_index_hashing, op9_content_addressed, op10_log_bilinear,
    op11_flow_resharding, op12_suffix_quicksort, op13_limited_accumulators)}

_OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i AS pos, array_to_string(ws[i:i + 12], ' ') AS g
        FROM w, unnest(range(1, greatest(len(ws) - 12, 0) + 1)) t(i)),
lo AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, pos + k AS i FROM win JOIN lo USING (g), range(13) r(k) WHERE doc_id > m),
words AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) t(i)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS s
         FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

_OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, h, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits FROM p),
d AS (SELECT page_id, h, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(1 + 16 * CAST(substr(bits, 5 * k + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * k + 2, 1) AS INT)
      + 4 * CAST(substr(bits, 5 * k + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * k + 4, 1) AS INT)
      + CAST(substr(bits, 5 * k + 5, 1) AS INT) AS INT), 1)), '') AS digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS newest FROM d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < newest THEN newest END AS refers_to
FROM m"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
dn AS (SELECT doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
tot AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM dn),
post AS (SELECT doc_id, n, t AS term, count(*) AS tf FROM dn, unnest(ts) u(t) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT item_id, t AS term, count(*) AS qtf FROM (SELECT item_id, {_TERMS} AS ts FROM benchmark), unnest(ts) u(t) GROUP BY ALL),
w AS (SELECT item_id, term, qtf * CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
      FROM q JOIN dfs USING (term), tot),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
      FROM w JOIN post USING (term), tot GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 20"""

_OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(u.x, '[^\x20\x09]+') AS ws FROM d, unnest(ps) u(x)),
nn AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k.k AS k, array_to_string(ws[i:i + k.k - 1], ' ') AS phrase
      FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) k, unnest(range(1, greatest(len(ws) - k.k + 1, 0) + 1)) t(i)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
        FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inn AS (SELECT lang, array_to_string(ws[i:i + m.m - 1], ' ') AS phrase, max(a) AS longer
        FROM c, (SELECT unnest([2, 3]) AS m) m, unnest(range(1, greatest(k - m.m + 1, 0) + 1)) t(i) WHERE m.m < k GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inn USING (lang, phrase)
         WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM r JOIN nn USING (lang) WHERE rank <= 2000"""

#: The others need a tokenizer, XXH64 or a trained model, which SQL lacks;
#: tests/llm holds them against brute force.
ORACLE_SQL = {"op6_level_doubling": _OP6_SQL, "op9_content_addressed": _OP9_SQL,
              "op12_suffix_quicksort": _OP12_SQL, "op13_limited_accumulators": _OP13_SQL}
