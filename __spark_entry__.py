"""

``queries()[name](spark, sf_dir)`` builds one operator (survey section 2
IDs in the comments) over the driver tables or data Spark derives from
them; ``oracle_sql()[name]`` states the same semantics as flat DuckDB SQL.
Column names match between the two. Timestamps are rendered as text and
derived doubles rounded in both, so values compare exactly.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles as O  # noqa: E402
from strata.functions import records as R  # noqa: E402
from strata.functions import text as TX  # noqa: E402
from strata.functions import urls as U  # noqa: E402
from strata.operators import columns as C  # noqa: E402
from strata.operators import filters as FL  # noqa: E402
from strata.operators import html as H  # noqa: E402
from strata.operators import joins as J  # noqa: E402
from strata.operators import links as LK  # noqa: E402
from strata.operators import quality as Q  # noqa: E402
from strata.operators import windows as W  # noqa: E402
from strata.schemas import DATASETS  # noqa: E402
from strata.plans import datasets as DS  # noqa: E402
from strata.plans import listing as LS  # noqa: E402
from strata.plans import panel as PN  # noqa: E402
from strata.plans import flows as FLOWS  # noqa: E402
from strata.sources import api as API  # noqa: E402
from strata.sources import archive as A  # noqa: E402
from strata.sources.archive import archive_from_pages, with_archive_paths  # noqa: E402
from strata.sources.tables import load  # noqa: E402
from strata.sources import files as SRC  # noqa: E402
from strata.sinks import writers as SK  # noqa: E402
from strata.functions import charset as CS  # noqa: E402
from strata.streaming import jobs as ST  # noqa: E402
from strata.session import materialize, scratch_path, ship_package  # noqa: E402

try:  # the operators of the training-data pipeline are a part that may be left out
    import corpus_pipeline as PIPELINE  # noqa: E402
    from strata.llm import queries as LLM  # noqa: E402
except ModuleNotFoundError as e:  # that part, or a package that only it needs
    if (e.name or "").startswith("strata.") and not e.name.startswith("strata.llm"):
        raise
    PIPELINE = LLM = None

SMOKE_DIR = "/root/testdata/sf0.001"

ALLOW = r"^https?://"
DENY = r"/(the|and|to)$"
TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def ts(c) -> F.Column:
    return F.date_format(c, TS_FMT)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: pages -> links -> filter -> first-seen cap -> per host."""
    return LS.links_per_host(load(spark, SMOKE_DIR, "pages"), allow=ALLOW, deny=DENY)


_REG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def reg(name: str, sql: str | None):
    def deco(fn):
        _REG[name] = (fn, sql)
        return fn
    return deco


# ---------------------------------------------------------------- links (EXT-4, FN-4, FLT-1, LIM-1)

@reg("links_per_host", f"WITH {O.links_cte(None, ALLOW, DENY)} SELECT {O.host('link')} AS host, "
     "count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM kept GROUP BY 1")
def _links_per_host(spark, d):
    return LS.links_per_host(load(spark, d, "pages"), allow=ALLOW, deny=DENY)


@reg("discover_links", f"WITH {O.links_cte(None)} SELECT page_id, pos, link FROM kept")
def _discover_links(spark, d):
    return LK.discover_links(load(spark, d, "pages"))


@reg("filter_links", f"WITH {O.links_cte(5, ALLOW, DENY)} SELECT page_id, pos, link FROM kept")
def _filter_links(spark, d):
    return LK.discover_links(load(spark, d, "pages"), max_links=5, allow=ALLOW, deny=DENY)


@reg("discover_links_selector", f"WITH {O.links_cte(None, page=O.NAV)} SELECT page_id, pos, link FROM kept")
def _discover_links_selector(spark, d):  # EXT-4 with a link selector
    return LK.discover_links_selector(load(spark, d, "pages"), "nav a::attr(href)")


@reg("iri_to_uri", f"WITH {O.links_cte(None)} SELECT page_id, pos, {O.iri_to_uri('link')} AS uri FROM kept")  # FN-5
def _iri_to_uri(spark, d):
    links = LK.discover_links(load(spark, d, "pages"), max_links=None)
    return links.select("page_id", "pos", U.iri_to_uri("link").alias("uri"))


# ---------------------------------------------------------------- quality (AGG-*, FLT-2/3)

def _er(spark, d):
    return DS.event_records(load(spark, d, "events"))


def _dr(spark, d):
    return DS.doc_records(load(spark, d, "documents"), load(spark, d, "labels"))


@reg("record_summary", f"WITH {O.ER}, {O.SUMMARY} SELECT CAST(records AS BIGINT) AS records, "
     "CAST(9 AS BIGINT) AS fields, CAST(dup AS BIGINT) AS duplicate_entity_ids, "
     "CAST(shared AS BIGINT) AS shared_hash_rows, CAST(errs AS BIGINT) AS error_records FROM sm")
def _record_summary(spark, d):
    return Q.record_summary(_er(spark, d))


@reg("quality_notes", f"WITH {O.ER}, {O.SUMMARY} SELECT v.rule, v.note, v.text FROM ({O.NOTES_VALUES}) v(rule, note, text), sm "
     "WHERE CASE v.rule WHEN 1 THEN errs > 0 WHEN 2 THEN dup > 0 WHEN 3 THEN shared > 0 "
     "WHEN 4 THEN records = 0 ELSE records > 0 AND errs = 0 AND dup = 0 END")
def _quality_notes(spark, d):
    return Q.quality_notes(Q.record_summary(_er(spark, d)))


@reg("status_distribution", f"WITH {O.ER} SELECT CASE WHEN s = '' THEN 'missing' ELSE s END AS status, "
     "count(*) AS n FROM (SELECT coalesce(CAST(status_code AS VARCHAR), '') AS s FROM er) GROUP BY 1")
def _status_distribution(spark, d):
    return Q.status_distribution(_er(spark, d))


@reg("duplicate_entities", f"WITH {O.ER} SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_entity_ids "
     "FROM (SELECT entity_id, count(*) AS n FROM er WHERE entity_id <> '' GROUP BY 1 HAVING count(*) > 1)")
def _duplicate_entities(spark, d):
    return Q.duplicate_entities(_er(spark, d))


@reg("shared_hash_rows", f"WITH {O.DR} SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS shared_hash_rows "
     "FROM (SELECT content_hash, count(*) AS n FROM dr WHERE content_hash <> '' GROUP BY 1 HAVING count(*) > 1)")
def _shared_hash_rows(spark, d):
    return Q.shared_hash_rows(_dr(spark, d))


@reg("duplicates_by_key", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM "
     "(SELECT CAST(conv_id AS VARCHAR) AS k, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL "
     "GROUP BY 1 HAVING count(*) > 1)")
def _duplicates_by(spark, d):
    return Q.duplicates_by(load(spark, d, "conversations"), "conv_id")


@reg("missing_values", O.missing_values_sql())
def _missing_values(spark, d):
    mv = Q.missing_values(_dr(spark, d))
    return mv.select("field", "missing", F.round("rate", 4).alias("rate"))


@reg("records_per_group", f"WITH {O.ER} SELECT user_id, strftime(observed_at, '%Y%m') AS month, "
     "count(*) AS records FROM er GROUP BY 1, 2")
def _records_per_group(spark, d):
    er = _er(spark, d).withColumn("month", F.date_format("observed_at", "yyyyMM"))
    return Q.records_per_group(er, "user_id", "month")


@reg("latest_month", "SELECT user_id, max(strftime(ts, '%Y%m')) AS month FROM events GROUP BY 1")
def _latest_month(spark, d):
    ev = load(spark, d, "events").withColumn("m", F.date_format("ts", "yyyyMM"))
    return Q.latest_month(ev, "user_id", "m", as_of="2024-02-01")


@reg("region_variants", "WITH x AS (SELECT DISTINCT regexp_replace(lower(trim(n.n_name)), "
     f"{O.lit(O.WS)}, '', 'g') AS normalized, n.n_name AS variant FROM customer c JOIN nation n "
     "ON c.c_nationkey = n.n_nationkey), y AS (SELECT normalized, count(*) AS spellings FROM x GROUP BY 1 "
     "HAVING count(*) > 1) SELECT x.normalized, x.variant, y.spellings FROM x JOIN y USING (normalized)")
def _region_variants(spark, d):
    cn = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return Q.region_variants(cn, "n_name")


@reg("wave_coverage", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S.%f') AS wave, "
     "count(DISTINCT user_id) AS entities, count(*) AS rows FROM events GROUP BY 1")
def _wave_coverage(spark, d):
    cov = Q.wave_coverage(load(spark, d, "events"), "user_id", "ts", "day")
    return cov.select(ts("wave").alias("wave"), "entities", "rows")


@reg("row_unit_check", "WITH s AS (SELECT count(*) AS rows, count(DISTINCT CAST(conv_id AS VARCHAR) || ':' || "
     "CAST(turn AS VARCHAR)) AS distinct_keys, quantile_disc(length(text), 0.5) AS median_chars, "
     "count(DISTINCT conv_id) AS pages FROM conversations) SELECT rows, distinct_keys, median_chars, "
     "round(rows / greatest(pages, 1), 6) AS rows_per_page, "
     "(rows = distinct_keys AND median_chars <= 2000) AS is_observation FROM s")
def _row_unit_check(spark, d):
    cv = load(spark, d, "conversations").withColumn(
        "key", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    r = Q.row_unit_check(cv, "key", "text", "conv_id")
    return r.select("rows", "distinct_keys", F.col("median_chars").cast("bigint").alias("median_chars"),
                    F.round("rows_per_page", 6).alias("rows_per_page"), "is_observation")


@reg("provenance_completeness", f"WITH {O.ER} SELECT count(*) AS rows, count(*) FILTER (WHERE entity_id <> '' "
     "AND observed_at IS NOT NULL AND status_code IS NOT NULL AND content_hash <> '' AND error <> '') "
     "AS complete_rows, round(coalesce(avg(CASE WHEN entity_id <> '' AND observed_at IS NOT NULL AND "
     "status_code IS NOT NULL AND content_hash <> '' AND coalesce(error, '') <> '' THEN 1.0 ELSE 0.0 END), 0.0), 6) "
     "AS share FROM er")
def _provenance_completeness(spark, d):
    r = Q.provenance_completeness(_er(spark, d), ["entity_id", "observed_at", "status_code", "content_hash", "error"])
    return r.select("rows", "complete_rows", F.round("share", 6).alias("share"))


# ---------------------------------------------------------------- flags and filters (FLT-4..8, AGG-9)

@reg("boilerplate_lines", f"WITH {O.DOC_LINES} SELECT grp AS source, line, pages_with_line, pages FROM bp")
def _boilerplate_lines(spark, d):
    return FL.boilerplate_lines(load(spark, d, "documents"), "doc_id", "source", "text")


@reg("flag_text", f"WITH {O.DOC_LINES} SELECT dd.doc_id, false AS empty_title, "
     f"{O.blocked('dd.text')} AS blocked, "
     "(coalesce(p.n_lines, 0) > 0 AND p.n_lines = p.n_bp) AS boilerplate_only, coalesce(g.pages >= 3, false) AS judged "
     "FROM documents dd LEFT JOIN per_key p ON dd.doc_id = p.key LEFT JOIN per_group g ON dd.source = g.grp")
def _flag_text(spark, d):
    return FL.flag_text(load(spark, d, "documents"), "doc_id", "source", None, "text")


@reg("boilerplate_lines_10pct", f"WITH {O.doc_lines(0.1)} SELECT grp AS source, line, pages_with_line, pages FROM bp")
def _boilerplate_lines_10pct(spark, d):  # AGG-9 at a 10 % share, so the set is not empty on the driver tables
    return FL.boilerplate_lines(load(spark, d, "documents"), "doc_id", "source", "text", min_share=0.1)


@reg("flag_text_10pct", f"WITH {O.doc_lines(0.1)} SELECT dd.doc_id, false AS empty_title, "
     f"{O.blocked('dd.text')} AS blocked, "
     "(coalesce(p.n_lines, 0) > 0 AND p.n_lines = p.n_bp) AS boilerplate_only, coalesce(g.pages >= 3, false) AS judged "
     "FROM documents dd LEFT JOIN per_key p ON dd.doc_id = p.key LEFT JOIN per_group g ON dd.source = g.grp")
def _flag_text_10pct(spark, d):  # FLT-5 against the 10 % boilerplate set
    return FL.flag_text(load(spark, d, "documents"), "doc_id", "source", None, "text", min_share=0.1)


@reg("flag_price", "WITH st AS (SELECT o_orderpriority AS cat, count(o_totalprice) AS n, "
     "quantile_disc(o_totalprice, 0.25) AS q1, quantile_disc(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1) "
     "SELECT o.o_orderkey, o.o_orderpriority, o.o_totalprice, o.o_totalprice IS NULL AS unparseable, "
     "coalesce(o.o_totalprice < 0, false) AS negative, coalesce((o.o_totalprice < st.q1 - 3 * "
     "(st.q3 - st.q1) OR o.o_totalprice > st.q3 + 3 * (st.q3 - st.q1)), false) AS outlier "
     "FROM orders o LEFT JOIN st ON o.o_orderpriority IS NOT DISTINCT FROM st.cat")
def _flag_price(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return FL.flag_price(o, "o_totalprice", "o_orderpriority")


@reg("flag_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day, false AS unparseable_date, "
     "coalesce(o_orderdate > TIMESTAMP '1998-08-02', false) AS future_date, "
     "coalesce(o_orderdate < TIMESTAMP '1993-01-01', false) AS too_old FROM orders")
def _flag_date(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"))
    return FL.flag_date(o, "order_day", as_of="1998-08-02", floor="1993-01-01")


@reg("allowed_domains", f"SELECT page_id, url FROM pages WHERE {O.host('url')} IN "
     f"(SELECT {O.host('url')} FROM pages WHERE {O.host('url')} LIKE 'blog.%')")
def _allowed_domains(spark, d):
    p = load(spark, d, "pages").select("page_id", "url")
    doms = p.select(U.url_host("url").alias("domain")).filter(F.col("domain").startswith("blog."))
    return FL.allowed_domains(p, "url", doms)


@reg("fallback_short_page", f"SELECT page_id, length(html) < 1000 AS used_fallback, CASE WHEN length(html) < 1000 "
     f"THEN 'https://' || {O.host('url')} || '/' ELSE url END AS meta_url FROM pages")
def _fallback_short_page(spark, d):
    p = load(spark, d, "pages").select("page_id", "html", F.col("url").alias("meta_url"),
                                       F.concat(F.lit("https://"), U.url_host("url"), F.lit("/")).alias("month_url"))
    return FL.fallback_short_page(p, "html", ["meta_url"], ["month_url"]).select("page_id", "used_fallback", "meta_url")


# ---------------------------------------------------------------- ordered, limits, sets (WIN-*, LIM-*, SET-*)

@reg("first_seen", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER "
     "(PARTITION BY conv_id, role ORDER BY turn) AS rn FROM conversations) WHERE rn = 1")
def _first_seen(spark, d):
    return W.first_seen(load(spark, d, "conversations"), "role", "turn", per="conv_id")


@reg("latest_attempt", "SELECT source_url, event_id, strftime(fetched_at, '%Y-%m-%d %H:%M:%S.%f') AS fetched_at, "
     "status_code FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY "
     "(status_code BETWEEN 200 AND 299) DESC, fetched_at DESC) AS rn FROM (SELECT 'https://u' || "
     "CAST(user_id AS VARCHAR) || '.example.com/' AS source_url, event_id, ts AS fetched_at, CASE WHEN "
     "event_type = 'error' THEN 500 ELSE 200 END AS status_code FROM events)) WHERE rn = 1")
def _latest_attempt(spark, d):
    ev = load(spark, d, "events")
    att = ev.select(F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.com/")).alias("source_url"),
                    "event_id", F.col("ts").alias("fetched_at"),
                    F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"))
    best = W.latest_attempt(att, error=None)
    return best.select("source_url", "event_id", ts("fetched_at").alias("fetched_at"), "status_code")


@reg("crawl_schedule", f"SELECT page_id, url, {O.host('url')} AS host, row_number() OVER (PARTITION BY "
     f"{O.host('url')} ORDER BY page_id) AS position, CAST((row_number() OVER (PARTITION BY {O.host('url')} "
     "ORDER BY page_id) - 1) * 10.0 AS DOUBLE) AS start_offset_s FROM pages")
def _crawl_schedule(spark, d):
    p = load(spark, d, "pages").select("page_id", "url")
    return W.crawl_schedule(p, U.url_host("url"), "page_id", 10.0)


@reg("pacing_violations", f"WITH {O.FL}, lg AS (SELECT event_id, host, fetched_at, lag(fetched_at) OVER "
     "(PARTITION BY host ORDER BY fetched_at, event_id) AS prev FROM fl) SELECT event_id, host, "
     "round((epoch_us(fetched_at) - epoch_us(prev)) / 1e6, 6) AS gap_s FROM lg WHERE prev IS NOT NULL "
     "AND (epoch_us(fetched_at) - epoch_us(prev)) / 1e6 < 10")
def _pacing_violations(spark, d):
    v = W.pacing_violations(DS.fetch_log(load(spark, d, "events")), "host", "fetched_at", 10.0, tiebreak="event_id")
    return v.select("event_id", "host", F.round("gap_s", 6).alias("gap_s"))


@reg("panel_duplicates", f"WITH {O.ER} SELECT event_id, entity_id, dup_count FROM (SELECT event_id, entity_id, "
     "count(*) OVER (PARTITION BY entity_id, date_trunc('hour', observed_at)) AS dup_count FROM er) WHERE dup_count > 1")
def _panel_duplicates(spark, d):
    er = _er(spark, d).withColumn("observed_hour", F.date_trunc("hour", "observed_at"))
    return W.panel_duplicates(er, ("entity_id", "observed_hour")).select("event_id", "entity_id", "dup_count")


@reg("coverage_drops", "WITH c AS (SELECT date_trunc('day', ts) AS wave, count(DISTINCT user_id) AS entities "
     "FROM events GROUP BY 1), l AS (SELECT wave, entities, lag(entities) OVER (ORDER BY wave) AS prev_entities "
     "FROM c) SELECT strftime(wave, '%Y-%m-%d %H:%M:%S.%f') AS wave, entities, prev_entities, "
     "round(1 - entities / prev_entities, 6) AS drop_share FROM l WHERE prev_entities IS NOT NULL "
     "AND 1 - entities / prev_entities > 0.2")
def _coverage_drops(spark, d):
    cov = Q.wave_coverage(load(spark, d, "events"), "user_id", "ts", "day")
    out = W.coverage_drops(cov, 0.2)
    return out.select(ts("wave").alias("wave"), "entities", "prev_entities", F.round("drop_share", 6).alias("drop_share"))


@reg("unit_changes", "SELECT event_id, user_id, event_type, prev_event_type, CASE WHEN prev_event_type IS NULL "
     "THEN 'new' WHEN prev_event_type <> event_type THEN 'changed' ELSE 'same' END AS unit_status FROM "
     "(SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) "
     "AS prev_event_type FROM events)")
def _unit_changes(spark, d):
    ev = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    out = W.unit_changes(ev, "user_id", "ts", ["event_type"], tiebreak="event_id")
    return out.select("event_id", "user_id", "event_type", "prev_event_type", "unit_status")


@reg("content_changes", "WITH w AS (SELECT user_id, date_trunc('day', ts) AS wave, sha256(props) AS h, "
     "row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) AS rn "
     "FROM events), l AS (SELECT user_id, wave, h AS content_hash, lag(h) OVER (PARTITION BY user_id "
     "ORDER BY wave) AS prev_hash FROM w WHERE rn = 1) SELECT user_id, strftime(wave, '%Y-%m-%d %H:%M:%S.%f') "
     "AS wave, content_hash, prev_hash, CASE WHEN prev_hash IS NULL THEN 'new' WHEN prev_hash <> content_hash "
     "THEN 'changed' ELSE 'same' END AS change FROM l")
def _content_changes(spark, d):
    ev = load(spark, d, "events").withColumn("h", R.content_hash("props"))
    out = W.content_changes(ev, "user_id", "ts", "h", "day", tiebreak="event_id")
    return out.select("user_id", ts("wave").alias("wave"), "content_hash", "prev_hash", "change")


@reg("cap_per_group", "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER "
     "(PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 3")
def _cap_per_group(spark, d):
    cv = load(spark, d, "conversations").select("conv_id", "turn", "role")
    return W.cap_per_group(cv, "conv_id", ["turn"], 3)


@reg("first_n", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 100")
def _first_n(spark, d):
    return W.first_n(load(spark, d, "pages").select("page_id", "url"), ["page_id"], 100)


@reg("sample_head", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 3")
def _sample_head(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return W.sample_head(li, ["l_orderkey", "l_linenumber"], 3)


@reg("new_and_gone", "WITH p AS (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-16'), "
     "c AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-16') "
     "SELECT user_id, 'new' AS status FROM c WHERE user_id NOT IN (SELECT user_id FROM p) "
     "UNION ALL SELECT user_id, 'gone' FROM p WHERE user_id NOT IN (SELECT user_id FROM c)")
def _new_and_gone(spark, d):
    ev = load(spark, d, "events")
    cut = F.lit("2024-01-16").cast("timestamp")
    return W.new_and_gone(ev.filter(F.col("ts") < cut), ev.filter(F.col("ts") >= cut), "user_id")


@reg("new_and_gone_daily", "WITH p AS (SELECT DISTINCT user_id FROM events WHERE date_trunc('day', ts) = "
     "TIMESTAMP '2024-01-01'), c AS (SELECT DISTINCT user_id FROM events WHERE date_trunc('day', ts) = "
     "TIMESTAMP '2024-01-02') SELECT user_id, 'new' AS status FROM c WHERE user_id NOT IN (SELECT user_id FROM p) "
     "UNION ALL SELECT user_id, 'gone' FROM p WHERE user_id NOT IN (SELECT user_id FROM c)")
def _new_and_gone_daily(spark, d):  # SET-2 between two consecutive day waves
    ev = load(spark, d, "events").withColumn("wave", F.date_trunc("day", "ts"))
    return W.new_and_gone(ev.filter(F.col("wave") == F.lit("2024-01-01").cast("timestamp")),
                          ev.filter(F.col("wave") == F.lit("2024-01-02").cast("timestamp")), "user_id")


@reg("wave_turnover", "WITH s AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS wave FROM events), "
     "w AS (SELECT wave, lag(wave) OVER (ORDER BY wave) AS prev FROM (SELECT DISTINCT wave FROM s)), "
     "x AS (SELECT s.user_id, w.wave, 'new' AS status FROM s JOIN w USING (wave) WHERE prev IS NOT NULL AND NOT EXISTS "
     "(SELECT 1 FROM s t WHERE t.user_id = s.user_id AND t.wave = w.prev) UNION ALL "
     "SELECT s.user_id, w.wave, 'gone' FROM s JOIN w ON s.wave = w.prev WHERE NOT EXISTS "
     "(SELECT 1 FROM s t WHERE t.user_id = s.user_id AND t.wave = w.wave)) "
     "SELECT user_id, strftime(wave, '%Y-%m-%d %H:%M:%S.%f') AS wave, status FROM x")
def _wave_turnover(spark, d):  # SET-2 over all consecutive waves
    return W.wave_turnover(load(spark, d, "events"), "user_id", "ts").select("user_id", ts("wave").alias("wave"), "status")


@reg("coverage_drops_5pct", "WITH c AS (SELECT date_trunc('day', ts) AS wave, count(DISTINCT user_id) AS entities "
     "FROM events GROUP BY 1), l AS (SELECT wave, entities, lag(entities) OVER (ORDER BY wave) AS prev_entities "
     "FROM c) SELECT strftime(wave, '%Y-%m-%d %H:%M:%S.%f') AS wave, entities, prev_entities, "
     "round(1 - entities / prev_entities, 6) AS drop_share FROM l WHERE prev_entities IS NOT NULL "
     "AND 1 - entities / prev_entities > 0.05")
def _coverage_drops_5pct(spark, d):  # WIN-6 at a 5 % threshold
    cov = Q.wave_coverage(load(spark, d, "events"), "user_id", "ts", "day")
    out = W.coverage_drops(cov, 0.05)
    return out.select(ts("wave").alias("wave"), "entities", "prev_entities", F.round("drop_share", 6).alias("drop_share"))


# ---------------------------------------------------------------- joins (JN-*, SET-1, AGG-7)

def _arch_meta(pages):
    return archive_from_pages(pages).select("source_url", "status_code", "content_hash")


def _batch(spark, d):
    pages = load(spark, d, "pages")
    links = LK.discover_links(pages)
    req = (pages.select((F.col("page_id") * 1000).alias("seq"), F.col("url"))
           .unionByName(links.select((F.col("page_id") * 1000 + F.col("pos")).alias("seq"), F.col("link").alias("url"))))
    return J.batch_extract(req, _arch_meta(pages))


@reg("batch_extract", f"WITH {O.links_cte(None)}, {O.BATCH} SELECT seq, source_url, status_code, content_hash, error, row_kind FROM batch")
def _batch_extract(spark, d):
    return _batch(spark, d).select("seq", "source_url", "status_code", "content_hash", "error", "row_kind")


@reg("failure_counts", f"WITH {O.links_cte(None)}, {O.BATCH} SELECT kind, error, count(*) AS n, "
     "CAST(GROUPING(kind, error) AS INTEGER) AS level FROM (SELECT 'failed_request' AS kind, error FROM batch "
     "WHERE error IS NOT NULL AND error <> '') GROUP BY ROLLUP (kind, error)")
def _failure_counts(spark, d):
    return Q.failure_counts(_batch(spark, d))


@reg("listing_details", f"WITH {O.links_cte(None)}, arch AS (SELECT url AS source_url, 200 AS status_code, "
     "sha256(html) AS content_hash FROM pages) SELECT k.link AS source_url, k.page_id, p.url AS listing_url, "
     "sha256(p.html) AS listing_content_hash, k.pos, a.status_code, a.content_hash, CASE WHEN a.source_url IS NULL "
     "THEN 1 ELSE 0 END AS row_kind, CASE WHEN a.source_url IS NULL THEN 'no archived response' END AS error "
     "FROM kept k JOIN pages p ON k.page_id = p.page_id LEFT JOIN arch a ON a.source_url = k.link")
def _listing_details(spark, d):
    pages = load(spark, d, "pages")
    lp = pages.select("page_id", "url", "html", F.col("url").alias("listing_url"),
                      R.content_hash("html").alias("listing_content_hash"))
    links = LK.discover_links(lp, keys=("page_id", "listing_url", "listing_content_hash"))
    out = J.listing_details(links, _arch_meta(pages))
    return out.select("source_url", "page_id", "listing_url", "listing_content_hash", "pos", "status_code",
                      "content_hash", "row_kind", "error")


def _extracted(pages):
    return FLOWS.extract_records(archive_from_pages(pages).drop("page_id"))


@reg("listing_records", f"WITH {O.links_cte(None)}, arch AS (SELECT url AS source_url, 200 AS status_code, "
     "sha256(html) AS content_hash FROM pages) SELECT k.link AS source_url, p.url AS listing_url, "
     "sha256(p.html) AS listing_content_hash, k.pos, a.status_code, a.content_hash, a.source_url IS NOT NULL AS extracted, "
     "CASE WHEN a.source_url IS NULL THEN 'no archived response' END AS error "
     "FROM kept k JOIN pages p ON k.page_id = p.page_id LEFT JOIN arch a ON a.source_url = k.link")
def _listing_records(spark, d):  # the listing flow: links -> extracted detail records, or failures
    pages = load(spark, d, "pages")
    out = FLOWS.listing_dataset(pages, _extracted(pages), base="url", listing_url="url")
    return out.select("source_url", "listing_url", "listing_content_hash", "pos", "status_code", "content_hash",
                      F.col("text").isNotNull().alias("extracted"), "error")


@reg("url_list_records", f"WITH {O.links_cte(None)}, {O.BATCH} SELECT source_url, status_code, content_hash, error, "
     "row_kind = 0 AS extracted FROM batch")
def _url_list_records(spark, d):  # the URL-list flow: a file of URLs -> extracted records, or failures
    pages = load(spark, d, "pages")
    path = scratch_path(spark, "urls") + "/urls.csv"
    urls = pages.select("url").unionByName(LK.discover_links(pages).select(F.col("link").alias("url")))
    urls.write.option("header", True).option("escape", '"').csv(path)
    out = FLOWS.url_list_dataset(spark, path, _extracted(pages))
    return out.select("source_url", "status_code", "content_hash", "error", F.col("text").isNotNull().alias("extracted"))


@reg("api_observations", f"WITH {O.OBS} SELECT * FROM obs")
def _api_observations(spark, d):
    return PN.api_observations(load(spark, d, "events"))


@reg("assemble_panel", f"WITH {O.OBS} SELECT * FROM obs WHERE (\"城市\", \"月份\") IN "
     "(SELECT (CAST(user_id AS VARCHAR), max(strftime(ts, '%Y%m'))) FROM events GROUP BY user_id)")
def _assemble_panel(spark, d):
    return PN.assemble_panel(load(spark, d, "events"))


@reg("panel_publish", f"WITH {O.OBS} SELECT \"城市\" AS city, \"日期\" AS date, \"AQI\" AS aqi, "
     "\"PM2.5\" AS pm2_5, '' AS wind, extraction_errors FROM obs WHERE (\"城市\", \"月份\") IN "
     "(SELECT (CAST(user_id AS VARCHAR), max(strftime(ts, '%Y%m'))) FROM events GROUP BY user_id)")
def _panel_publish(spark, d):  # JN-3 -> PRJ-2/3 -> SNK-5: the published final Parquet, read back
    root = scratch_path(spark, "panel")
    PN.panel_dataset(load(spark, d, "events"), root + "/processed", root + "/final", PROJECT_REQUEST, "en")
    return spark.read.parquet(root + "/final/panel.parquet")


# Events spread over three months by user, for month choices that can differ.
MONTHS_CTE = "em AS (SELECT * REPLACE (ts + to_months(CAST(user_id % 3 AS INTEGER)) AS ts) FROM events), "
MONTHS_OBS = MONTHS_CTE + O.OBS.replace("FROM events", "FROM em")


def _month_events(spark, d):
    ev = load(spark, d, "events")
    return ev.withColumn("ts", F.col("ts") + F.make_ym_interval(F.lit(0), (F.col("user_id") % 3).cast("int")))


@reg("panel_explicit_month", f"WITH {MONTHS_OBS} SELECT * FROM obs WHERE \"月份\" = '202402' UNION ALL "
     "SELECT 'city-api:' || city || ':202402:no_data', city, '202402', '', '', '', '', '', '', '', '', '', '', "
     "'no_items', 'API returned no day-level items', NULL FROM (SELECT DISTINCT city FROM ev EXCEPT "
     "SELECT city FROM ev WHERE month = '202402')")
def _panel_explicit_month(spark, d):  # JN-3 with a month that many cities lack
    return PN.assemble_panel(_month_events(spark, d), "202402")


@reg("latest_month_spread", f"WITH {MONTHS_CTE[:-2]} SELECT user_id, max(strftime(ts, '%Y%m')) AS month FROM em GROUP BY 1")
def _latest_month_spread(spark, d):  # AGG-11 over several months
    ev = _month_events(spark, d).withColumn("m", F.date_format("ts", "yyyyMM"))
    return Q.latest_month(ev, "user_id", "m", as_of="2024-02-01")


@reg("panel_report", f"WITH {MONTHS_OBS}, p AS (SELECT * FROM obs WHERE (\"城市\", \"月份\") IN (SELECT (city, max(month)) "
     "FROM ev GROUP BY city)) SELECT count(*) AS records, CAST(6 AS BIGINT) AS fields, CAST(0 AS BIGINT) AS "
     "duplicate_entity_ids, CAST(0 AS BIGINT) AS shared_hash_rows, count(extraction_errors) AS error_records FROM p")
def _panel_report(spark, d):  # the audit of the published panel
    root = scratch_path(spark, "panel")
    _, report = PN.panel_dataset(_month_events(spark, d), root + "/processed", root + "/final", PROJECT_REQUEST, "en",
                                 formats=("parquet",))
    return report["summary"]


# Each user's events spread over three months; a day page has 15 characters and 42 a record.
LINEAGE_OBS = "em AS (SELECT * REPLACE (ts + to_months(CAST(event_id % 3 AS INTEGER)) AS ts) FROM events), " \
    + O.OBS.replace("FROM events", "FROM em")


@reg("panel_lineage", f"WITH {LINEAGE_OBS}, c AS (SELECT city, max(month) AS month FROM ev GROUP BY city), "
     "p AS (SELECT city, month, count(*) AS n FROM ev JOIN c USING (city, month) GROUP BY ALL) "
     "SELECT obs.* EXCLUDE (event_id), obs.event_id, 'https://api.example.com/history?city=' || city || '&month=' || month AS source_url, "
     "source_url AS final_url, CASE WHEN 15 + 42 * n < 1000 THEN 'https://www.example.com/monthdata.php?city=' || city "
     "ELSE 'https://www.example.com/daydata.php?city=' || city || '&month=' || month END AS page_url, "
     "strftime(em.ts, '%Y-%m-%d %H:%M:%S.%f') AS fetched_at, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, "
     "'raw/api/' || CAST(em.event_id AS VARCHAR) || '.json' AS raw_file_path, CASE WHEN 15 + 42 * n < 1000 THEN "
     "'raw/month/' || city || '.html' ELSE 'raw/day/' || city || '_' || month || '.html' END AS page_raw_file_path, "
     "'meta/api/' || CAST(em.event_id AS VARCHAR) || '.json' AS metadata_file_path, 'history-api' AS extractor_name, "
     "'0.1.0' AS extractor_version, 'getHistory' AS api_method, 15 + 42 * n < 1000 AS used_fallback, 64 AS hash_chars "
     "FROM obs JOIN em USING (event_id) JOIN p ON p.city = obs.\"城市\" AND p.month = obs.\"月份\"")
def _panel_lineage(spark, d):  # EXT-6, AGG-11, JN-3, FLT-4, EXT-7, PRJ-6, SNK-5: published, read back
    ev = load(spark, d, "events")
    ev = ev.withColumn("ts", F.col("ts") + F.make_ym_interval(F.lit(0), (F.col("event_id") % 3).cast("int")))
    root = scratch_path(spark, "panel")
    out, _ = PN.panel_lineage_dataset(ev, root + "/processed", root + "/final")
    return out.withColumns({"fetched_at": ts("fetched_at"), "hash_chars": F.length("content_hash")}).drop("content_hash")


@reg("archive_files", "SELECT page_id, CASE WHEN (page_id % 11 = 3 OR html IS NULL) THEN 'no_body' WHEN page_id % 13 = 5 THEN 'no_sidecar' "
     "WHEN page_id % 17 = 7 THEN 'partial' ELSE 'ok' END AS archive_status, "
     "CASE WHEN page_id % 13 <> 5 OR (page_id % 11 = 3 OR html IS NULL) THEN url END AS source_url, CASE WHEN (page_id % 11 = 3 OR html IS NULL) THEN NULL "
     "WHEN page_id % 17 = 7 THEN sha256('<') ELSE sha256(html) END AS body_sha256 FROM pages")
def _archive_files(spark, d):  # SRC-3: body and sidecar a response, some lost or cut off
    root, page = scratch_path(spark, "archive-files"), F.col("page_id")
    arch = A.archive_from_pages(load(spark, d, "pages"))
    lost, alone, cut = (page % 11 == 3) | F.col("body").isNull(), page % 13 == 5, page % 17 == 7
    meta = F.to_json(F.struct("source_url", "final_url", F.col("fetched_at").cast("string").alias("fetched_at"), "status_code",
                              "content_hash", "headers"))
    files = arch.select(F.concat(F.lit("page-"), page).alias("stem"), "headers",
                        F.when(lost, None).when(cut, F.lit(b"<")).otherwise(F.col("body")).alias("body"),
                        F.when(alone & ~lost, None).otherwise(meta).alias("meta"))
    A.write_archive_files(files, root + "/raw", root + "/meta")
    out = A.read_archive_files(spark, root + "/raw", root + "/meta")
    return out.select(F.substring_index("stem", "-", -1).cast("long").alias("page_id"), "archive_status", "source_url",
                      R.content_hash("body").alias("body_sha256"))


@reg("seed_or_discovered", "WITH b AS (SELECT c_name, c_custkey, 0 AS prio FROM customer WHERE c_mktsegment = 'SEED' "
     "UNION ALL SELECT c_name, c_custkey, 1 FROM customer) SELECT c_name, c_custkey FROM b "
     "WHERE prio = (SELECT min(prio) FROM b) ORDER BY c_custkey LIMIT 50")
def _seed_or_discovered(spark, d):
    cu = load(spark, d, "customer")
    return J.seed_or_discovered(cu.filter(F.col("c_mktsegment") == "SEED"), cu, "c_name", "c_custkey", 50)


@reg("missing_raw_files", "SELECT 'raw/' || CAST(doc_id AS VARCHAR) AS raw_file_path, doc_id FROM documents "
     "WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _missing_raw_files(spark, d):
    docs = load(spark, d, "documents").select(
        F.concat(F.lit("raw/"), F.col("doc_id").cast("string")).alias("raw_file_path"), "doc_id")
    files = load(spark, d, "labels").select(F.concat(F.lit("raw/"), F.col("doc_id").cast("string")).alias("path"))
    return J.missing_raw_files(docs, files)


@reg("missing_waves", "WITH w AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS wave FROM events), "
     "s AS (SELECT user_id, min(wave) AS lo, max(wave) AS hi FROM w GROUP BY 1), g AS (SELECT user_id, "
     "unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS wave FROM s) SELECT user_id, "
     "strftime(wave, '%Y-%m-%d %H:%M:%S.%f') AS wave FROM (SELECT * FROM g EXCEPT SELECT * FROM w)")
def _missing_waves(spark, d):
    out = J.missing_waves(load(spark, d, "events"), "user_id", "ts", "day")
    return out.select("user_id", ts("wave").alias("wave"))


@reg("unmatched_regions", "SELECT c_custkey, c_nationkey, 'missing' AS reason FROM customer WHERE c_nationkey IS NULL "
     "UNION ALL SELECT c_custkey, c_nationkey, 'unknown' FROM customer WHERE c_nationkey IS NOT NULL AND "
     "c_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def _unmatched_regions(spark, d):
    cu = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    return J.unmatched_regions(cu, "c_nationkey", load(spark, d, "nation"), "n_nationkey")


@reg("robots_allowed", O.ROBOTS_SQL)
def _robots_allowed(spark, d):
    p = load(spark, d, "pages").select("page_id", "url")
    hosts = p.select(U.url_host("url").alias("host")).distinct().filter(F.col("host").startswith("blog."))
    rules = hosts.select("host", F.inline(F.array(
        F.struct(F.lit("/").alias("prefix"), F.lit(True).alias("allow")),
        F.struct(F.lit("/en/").alias("prefix"), F.lit(False).alias("allow")),
        F.struct(F.lit("/en/1").alias("prefix"), F.lit(True).alias("allow")))))
    return J.robots_allowed(p, rules, "url").select("page_id", "url", "allowed")


# ---------------------------------------------------------------- columns (PRJ-*)

@reg("flatten_nested", f"WITH {O.links_cte(None)}, agg AS (SELECT page_id, list(link ORDER BY pos) AS l FROM kept "
     "GROUP BY 1) SELECT p.page_id, CASE WHEN len(coalesce(a.l, [])) = 1 THEN a.l[1] ELSE "
     "CAST(to_json(coalesce(a.l, []::VARCHAR[])) AS VARCHAR) END AS links FROM pages p LEFT JOIN agg a ON p.page_id = a.page_id")
def _flatten_nested(spark, d):
    p = LK.with_link_inputs(load(spark, d, "pages"))
    arr = p.select("page_id", LK.link_array("__refs", "__bp").alias("links"))
    return C.flatten_nested(arr, scalarize=["links"])


PROJECT_REQUEST = ["city", "date", "aqi", "PM2_5", "AQI", "wind"]


@reg("project_localize", f"WITH {O.OBS} SELECT \"城市\" AS city, \"日期\" AS date, \"AQI\" AS aqi, "
     "\"PM2.5\" AS pm2_5, '' AS wind, extraction_errors FROM obs")
def _project_localize(spark, d):
    obs = PN.api_observations(load(spark, d, "events"))
    return C.localize_columns(C.project_columns(obs, PROJECT_REQUEST), "en")


@reg("safe_columns", None)  # names are computed below for the oracle
def _safe_columns(spark, d):
    return C.safe_columns(PN.api_observations(load(spark, d, "events")))


@reg("conform_price", "SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS entity_id, CAST(NULL AS TIMESTAMP) AS observed_at, "
     "p_name AS \"商品名称\", CAST(p_retailprice AS DECIMAL(18, 2)) AS \"价格\", 'USD' AS \"币种\", "
     "CAST(NULL AS VARCHAR) AS \"单位\", CAST(NULL AS VARCHAR) AS \"地区\", p_brand AS \"平台\", "
     "CAST(NULL AS VARCHAR) AS source_url, 0 AS n_conform_errors FROM part")
def _conform_price(spark, d):
    p = load(spark, d, "part")
    out = C.conform(p, "price", {
        "entity_id": F.concat(F.lit("part:"), F.col("p_partkey").cast("string")),
        "商品名称": F.col("p_name"), "价格": F.col("p_retailprice"), "币种": F.lit("USD"),
        "平台": F.col("p_brand")})
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c != "conform_errors"],
                      F.size("conform_errors").alias("n_conform_errors"))


@reg("localize_zh", f"WITH {O.OBS} SELECT entity_id AS \"实体ID\", \"城市\", \"日期\", \"AQI\", extraction_errors AS \"抽取错误\" FROM obs")
def _localize_zh(spark, d):  # PRJ-3, Chinese output; 'auto' picks it by the table's own columns
    obs = PN.api_observations(load(spark, d, "events")).select("entity_id", "城市", "日期", "AQI", "extraction_errors")
    return C.localize_columns(obs, "auto")


def _conformed(df, dataset, mapping):
    return C.conform(df, dataset, mapping).withColumn("conform_errors", F.array_join("conform_errors", ","))


def _text_unless(period, key, word, other):
    """``other`` as text, but ``word`` where the key is a multiple of ``period``."""
    return F.when(F.col(key) % period == 0, F.lit(word)).otherwise(other.cast("string"))


def _conform_sql(dataset, table, values, bad):
    """The declared columns of ``dataset`` in order: ``values`` by name, else
    null of the type; ``bad`` are (name, condition) of casts that fail."""
    names = {"timestamp": "TIMESTAMP", "date": "DATE", "double": "DOUBLE", "int": "INTEGER", "string": "VARCHAR", "decimal(18,2)": "DECIMAL(18, 2)"}
    cols = [f"TRY_CAST({values.get(n, 'NULL')} AS {names[t.simpleString()]}) AS \"{n}\"" for n, t in DATASETS[dataset]]
    errors = ", ".join(f"CASE WHEN {cond} THEN '{n}' END" for n, cond in bad)
    return f"SELECT {', '.join(cols)}, concat_ws(',', {errors}) AS conform_errors FROM {table}"


@reg("conform_housing", _conform_sql("housing", "orders", {
    "entity_id": "'order:' || CAST(o_orderkey AS VARCHAR)", "标题": "o_orderpriority", "城市": "o_orderstatus",
    "总价": "CASE WHEN o_orderkey % 11 = 0 THEN '面议' ELSE CAST(o_custkey AS VARCHAR) || '.25' END",
    "面积": "CASE WHEN o_orderkey % 7 = 0 THEN 'large' ELSE CAST(o_custkey AS VARCHAR) END"},
    [("总价", "o_orderkey % 11 = 0"), ("面积", "o_orderkey % 7 = 0")]))
def _conform_housing(spark, d):  # PRJ-8 with failed casts to decimal and double
    cust = F.col("o_custkey").cast("string")
    return _conformed(load(spark, d, "orders"), "housing", {
        "entity_id": F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")), "标题": F.col("o_orderpriority"),
        "城市": F.col("o_orderstatus"), "总价": _text_unless(11, "o_orderkey", "面议", F.concat(cust, F.lit(".25"))),
        "面积": _text_unless(7, "o_orderkey", "large", cust)})


@reg("conform_jobs", _conform_sql("jobs", "events", {
    "entity_id": "CAST(event_id AS VARCHAR)", "observed_at": "ts", "职位名称": "event_type", "薪资": "CAST(user_id AS VARCHAR)",
    "发布日期": "CASE WHEN event_id % 5 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END"}, [("发布日期", "event_id % 5 = 0")])
    .replace('TRY_CAST(ts AS TIMESTAMP) AS "observed_at"', "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS observed_at")
    .replace('AS DATE) AS "发布日期"', 'AS DATE)::VARCHAR AS "发布日期"'))
def _conform_jobs(spark, d):  # PRJ-8 with failed casts to dates
    out = _conformed(load(spark, d, "events"), "jobs", {
        "entity_id": F.col("event_id").cast("string"), "observed_at": F.col("ts"), "职位名称": F.col("event_type"),
        "薪资": F.col("user_id").cast("string"), "发布日期": _text_unless(5, "event_id", "soon", F.date_format("ts", "yyyy-MM-dd"))})
    return out.withColumns({"observed_at": ts("observed_at"), "发布日期": F.col("发布日期").cast("string")})


@reg("conform_announcements", _conform_sql("announcements", "documents", {
    "entity_id": "'doc:' || CAST(doc_id AS VARCHAR)", "标题": "lang", "发布机构": "source", "正文": "text",
    "发布日期": "CASE WHEN doc_id % 3 = 0 THEN '2024-13-01' ELSE '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END"},
    [("发布日期", "doc_id % 3 = 0")]).replace('AS DATE) AS "发布日期"', 'AS DATE)::VARCHAR AS "发布日期"'))
def _conform_announcements(spark, d):  # PRJ-8: dates that no calendar has
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    out = _conformed(load(spark, d, "documents"), "announcements", {
        "entity_id": F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), "标题": F.col("lang"), "发布机构": F.col("source"),
        "正文": F.col("text"), "发布日期": _text_unless(3, "doc_id", "2024-13-01", day)})
    return out.withColumn("发布日期", F.col("发布日期").cast("string"))


@reg("conform_air_quality", _conform_sql("air_quality", "events", {
    "entity_id": "CAST(event_id AS VARCHAR)", "城市": "CAST(user_id AS VARCHAR)",
    "AQI": "CASE WHEN event_id % 9 = 0 THEN 'high' ELSE CAST(event_id % 500 AS VARCHAR) END",
    "PM2.5": "CASE WHEN event_id % 6 = 0 THEN '--' ELSE CAST(event_id % 100 AS VARCHAR) || '.5' END"},
    [("AQI", "event_id % 9 = 0"), ("PM2.5", "event_id % 6 = 0")]))
def _conform_air_quality(spark, d):  # PRJ-8 with failed casts to int and double, also both in one row
    return _conformed(load(spark, d, "events"), "air_quality", {
        "entity_id": F.col("event_id").cast("string"), "城市": F.col("user_id").cast("string"),
        "AQI": _text_unless(9, "event_id", "high", F.col("event_id") % 500),
        "PM2.5": _text_unless(6, "event_id", "--", F.concat((F.col("event_id") % 100).cast("string"), F.lit(".5")))})


@reg("union_by_wave", "SELECT wave, outcome, count(*) AS n, count(error) AS n_errors, CAST(sum(user_id) AS BIGINT) AS users FROM "
     "(SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS wave, 'record' AS outcome, user_id, NULL AS error FROM events "
     "WHERE event_type <> 'error' UNION ALL SELECT strftime(date_trunc('week', ts), '%Y-%m-%d'), 'failure', NULL, event_type "
     "FROM events WHERE event_type = 'error') GROUP BY ALL")
def _union_by_wave(spark, d):  # SET-1 + FN-13: records and failures have different columns
    ev = load(spark, d, "events").withColumn("wave", F.date_format(TX.wave("ts", "week"), "yyyy-MM-dd"))
    ok = ev.where("event_type <> 'error'").select("wave", F.lit("record").alias("outcome"), "user_id")
    failed = ev.where("event_type = 'error'").select("wave", F.lit("failure").alias("outcome"), F.col("event_type").alias("error"))
    return W.union_records(ok, failed).groupBy("wave", "outcome").agg(
        F.count("*").alias("n"), F.count("error").alias("n_errors"), F.sum("user_id").alias("users"))


@reg("minimize_text", O.MINIMIZE_SQL)
def _minimize_text(spark, d):
    return C.minimize(load(spark, d, "documents"), ["doc_id", "text"], ["text"])


@reg("redact_headers", "SELECT page_id, k AS key, CASE WHEN lower(k) IN ('cookie', 'set-cookie', 'authorization', "
     "'proxy-authorization') THEN '[redacted]' ELSE v END AS value FROM (SELECT page_id, 'Content-Type' AS k, "
     "'text/html; charset=utf-8' AS v FROM pages UNION ALL SELECT page_id, 'Set-Cookie', 'sid=' || "
     "CAST(page_id AS VARCHAR) FROM pages UNION ALL SELECT page_id, 'X-Page-Id', CAST(page_id AS VARCHAR) FROM pages)")
def _redact_headers(spark, d):
    p = load(spark, d, "pages").select("page_id", F.create_map(
        F.lit("Content-Type"), F.lit("text/html; charset=utf-8"),
        F.lit("Set-Cookie"), F.concat(F.lit("sid="), F.col("page_id").cast("string")),
        F.lit("X-Page-Id"), F.col("page_id").cast("string")).alias("headers"))
    return p.select("page_id", F.explode(R.redact_headers("headers")).alias("key", "value"))


@reg("merge_extracted", "SELECT url AS source_url, 200 AS status_code, sha256(html) AS content_hash, "
     "regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, CASE WHEN regexp_extract(html, "
     "'(?s)<title>(.*?)</title>', 1) = '' THEN 'title: no match' END AS extraction_errors FROM pages")
def _merge_extracted(spark, d):
    pages = load(spark, d, "pages")
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    ex = pages.select(F.col("url").alias("source_url"), title.alias("title"),
                      F.when(title == "", F.array(F.lit("title: no match"))).alias("extraction_errors"))
    m = C.merge_extracted(_arch_meta(pages), ex, "source_url")
    return m.select("source_url", "status_code", "content_hash", "title",
                    F.array_join("extraction_errors", "; ").alias("extraction_errors"))


@reg("stamp_provenance", f"WITH {O.OBS}, m AS (SELECT event_id AS eid, 'https://api.example.com/history?city=' || "
     "CAST(user_id AS VARCHAR) || '&month=' || strftime(ts, '%Y%m') AS api_url, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') "
     "AS fetched, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, sha256(props) AS h, "
     "'https://www.example.com/daydata.php?city=' || CAST(user_id AS VARCHAR) || '&month=' || strftime(ts, '%Y%m') "
     "AS page FROM events) SELECT obs.entity_id, \"城市\", \"月份\", \"日期\", \"AQI\", \"质量等级\", "
     "\"PM2.5\", \"PM10\", \"SO2\", \"NO2\", \"CO\", \"O3\", \"排名\", \"数据状态\", api_url AS source_url, "
     "api_url AS final_url, page AS page_url, fetched AS fetched_at, status AS status_code, h AS content_hash, "
     "'raw/api/' || CAST(eid AS VARCHAR) || '.json' AS raw_file_path, 'raw/page/' || \"城市\" || '_' || \"月份\" "
     "|| '.html' AS page_raw_file_path, 'meta/api/' || CAST(eid AS VARCHAR) || '.json' AS metadata_file_path, "
     "'history-api' AS extractor_name, '0.1.0' AS extractor_version, 'getHistory' AS api_method, "
     "obs.extraction_errors, obs.event_id FROM obs JOIN m ON obs.event_id = m.eid")
def _stamp_provenance(spark, d):
    ev = load(spark, d, "events")
    obs = PN.api_observations(ev)
    meta = ev.select(
        F.col("event_id").alias("eid"),
        U.build_url(F.lit("https://api.example.com/history"), {
            "city": F.col("user_id").cast("string"), "month": F.date_format("ts", "yyyyMM")}).alias("api_url"),
        ts("ts").alias("fetched"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        R.content_hash("props").alias("h"),
        U.build_url(F.lit("https://www.example.com/daydata.php"), {
            "city": F.col("user_id").cast("string"), "month": F.date_format("ts", "yyyyMM")}).alias("page"))
    j = obs.join(meta, F.col("event_id") == F.col("eid"))
    api = {"source_url": F.col("api_url"), "final_url": F.col("api_url"), "fetched_at": F.col("fetched"),
           "status_code": F.col("status"), "content_hash": F.col("h"),
           "raw_file_path": F.concat(F.lit("raw/api/"), F.col("eid").cast("string"), F.lit(".json")),
           "metadata_file_path": F.concat(F.lit("meta/api/"), F.col("eid").cast("string"), F.lit(".json"))}
    page_raw = F.concat(F.lit("raw/page/"), F.col("`城市`"), F.lit("_"), F.col("`月份`"), F.lit(".html"))
    stamped = C.stamp_provenance(j, api, page_raw, F.col("page"), "history-api", "0.1.0", "getHistory")
    return C.project_columns(stamped.drop("eid", "api_url", "fetched", "status", "h", "page"))


# ---------------------------------------------------------------- scalar functions (FN-*)

@reg("content_hash", "SELECT page_id, sha256(html) AS content_hash FROM pages")
def _content_hash(spark, d):
    return load(spark, d, "pages").select("page_id", R.content_hash("html").alias("content_hash"))


@reg("archive_paths", "SELECT page_id, 'raw/' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 10), "
     "'%Y-%m-%dT%H%M%SZ0000') || '_' || substr(sha256(html), 1, 16) || '.html' AS raw_file_path FROM pages")
def _archive_paths(spark, d):
    a = with_archive_paths(archive_from_pages(load(spark, d, "pages")), "raw")
    return a.select("page_id", "raw_file_path")


@reg("query_params", "SELECT page_id, " + ", ".join(
    f"regexp_extract('&' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&{k}=([^&]*)', 1) AS {k}"
    for k in ["page", "ref", "utm_source"]) + " FROM pages")
def _query_params(spark, d):
    p = load(spark, d, "pages")
    return p.select("page_id", *[U.query_param("url", k).alias(k) for k in ["page", "ref", "utm_source"]])


@reg("build_url", "SELECT event_id, 'https://api.example.com/history?city=' || CAST(user_id AS VARCHAR) || "
     "'&month=' || strftime(ts, '%Y%m') || '&type=' || event_type AS url FROM events")
def _build_url(spark, d):
    ev = load(spark, d, "events")
    return ev.select("event_id", U.build_url(F.lit("https://api.example.com/history"), {
        "city": F.col("user_id").cast("string"), "month": F.date_format("ts", "yyyyMM"),
        "type": F.col("event_type")}).alias("url"))


@reg("page_titles", f"SELECT page_id, trim(regexp_replace({O.unescape_html5(O.TITLE_EXPR)}, "
     f"{O.lit(O.WS)}, ' ', 'g')) AS title FROM pages")
def _page_titles(spark, d):
    t = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return load(spark, d, "pages").select("page_id", TX.collapse_ws(TX.unescape(t)).alias("title"))


@reg("parse_amount", "WITH t AS (SELECT p_partkey, '¥' || format('{:,.2f}', p_retailprice) || '/件' AS price_text "
     "FROM part) SELECT p_partkey, price_text, CAST(replace(regexp_extract(price_text, "
     "'(-?[0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '') AS DECIMAL(18, 2)) AS amount, '¥' AS currency, "
     "'件' AS unit FROM t")
def _parse_amount(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.concat(F.lit("¥"), F.format_number("p_retailprice", 2),
                                                            F.lit("/件")).alias("price_text"))
    return p.select("p_partkey", "price_text", TX.parse_amount("price_text").alias("a")).select(
        "p_partkey", "price_text", "a.amount", "a.currency", "a.unit")


@reg("extract_months", "SELECT page_id, unnest(list_sort(list_distinct(regexp_extract_all(html, "
     "'daydata\\.php\\?city=[^\"''&<>]+&month=(\\d{6})', 1)))) AS month FROM pages")
def _extract_months(spark, d):
    m = API.extract_months(load(spark, d, "pages"), "html")
    return m.select("page_id", F.explode("months").alias("month"))


# ---------------------------------------------------------------- HTML extraction (EXT-1/2/3/5)

SELECT_SPEC = {"title": "title::text", "heading": "article h1::text", "nav": "nav a::attr(href)"}


@reg("shred_anchor_counts", "SELECT page_id, count(*) AS anchors FROM (SELECT page_id, unnest(regexp_extract_all("
     "html, '(?i)<a[\\s>]')) AS m FROM pages) GROUP BY 1")
def _shred_anchor_counts(spark, d):
    nodes = H.shred_elements(load(spark, d, "pages"))
    return nodes.filter(F.col("tag") == "a").groupBy("page_id").agg(F.count(F.lit(1)).alias("anchors"))


@reg("select_fields", "SELECT page_id, 'title' AS field, " + O.unescape_html5(O.TITLE_EXPR) + " AS value, "
     "CAST(NULL AS VARCHAR) AS error FROM pages UNION ALL SELECT page_id, 'heading', " +
     O.unescape_html5("regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)") + ", NULL FROM pages "
     "UNION ALL SELECT page_id, 'nav', CAST(to_json(regexp_extract_all(regexp_extract(html, "
     "'(?s)<nav>(.*?)</nav>', 1), 'href=\"([^\"]*)\"', 1)) AS VARCHAR), NULL FROM pages")
def _select_fields(spark, d):
    # the node table feeds several branches: parse once, cut lineage with a
    # Parquet table in the shared checkpoint folder (branches read only their columns)
    nodes = materialize(H.shred_elements(load(spark, d, "pages"), path_attrs=H.selector_attrs(*SELECT_SPEC.values())), "nodes")
    return H.field_records(H.select_fields(nodes, SELECT_SPEC))


@reg("extract_title_text", O.title_text_sql())  # EXT-1
def _extract_title_text(spark, d):
    return H.extract_title_text(load(spark, d, "pages"))


@reg("extract_scoped_names", "SELECT DISTINCT page_id, trim(name) AS name FROM (SELECT page_id, "
     "unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"[^\"]*/[^\"]*\"[^>]*>([^<]*)</a>', 1)) AS name "
     "FROM pages) WHERE trim(name) <> ''")
def _extract_scoped_names(spark, d):
    nodes = materialize(H.shred_elements(load(spark, d, "pages")), "nodes")
    return H.extract_scoped_names(nodes, "/").select("page_id", "name")


EXTRACT_SPEC = {"heading": "article h1::text", "nav": "nav a::attr(href)", "hover": "a:hover"}


@reg("extract_records", "SELECT 'raw/' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 10), "
     "'%Y-%m-%dT%H%M%SZ0000') || '_' || substr(sha256(html), 1, 16) || '.html' AS raw_file_path, url AS source_url, "
     "200 AS status_code, sha256(html) AS content_hash, " +
     O.unescape_html5("regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)") + " AS heading, "
     "CAST(to_json(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), 'href=\"([^\"]*)\"', 1)) "
     "AS VARCHAR) AS nav, 'hover: unsupported selector: ''a:hover''' AS extraction_errors FROM pages")
def _extract_records(spark, d):  # FN-2 + EXT-2/3 + PRJ-5 flow over archived bodies
    arch = with_archive_paths(archive_from_pages(load(spark, d, "pages")), "raw")
    recs = FLOWS.extract_records(arch, EXTRACT_SPEC)
    return recs.select("raw_file_path", "source_url", "status_code", "content_hash", "heading", "nav",
                       F.array_join("extraction_errors", "; ").alias("extraction_errors"))


# ---------------------------------------------------------------- charset decoding (FN-2)

@reg("decode_bodies", "SELECT page_id, html AS text FROM pages")
def _decode_bodies(spark, d):
    pages = load(spark, d, "pages")
    utf16 = U.url_host("url").startswith("blog.")  # these archives hold UTF-16 bodies, declared in the header
    bodies = pages.select(
        "page_id",
        F.when(utf16, F.encode("html", "UTF-16")).otherwise(F.encode("html", "UTF-8")).alias("body"),
        F.create_map(F.lit("Content-Type"), F.when(utf16, F.lit("text/html; charset=utf-16"))
                     .otherwise(F.lit("text/html"))).alias("headers"))
    return CS.decode_bodies(bodies).select("page_id", "text")


# ---------------------------------------------------------------- sources and sinks (SRC-*, SNK-*, JN-9)

ER_OUT = ["entity_id", "event_id", "user_id", "observed_at", "event_type", "status_code", "content_hash",
          "error", "value"]
ER_OUT_SQL = (f"WITH {O.ER} SELECT entity_id, event_id, user_id, strftime(observed_at, '%Y-%m-%d %H:%M:%S.%f') "
              "AS observed_at, event_type, status_code, content_hash, error, value FROM er")


def _er_out(df):
    return df.select(*[ts(c).alias(c) if c == "observed_at" else F.col(c) for c in ER_OUT])


@reg("jsonl_roundtrip", ER_OUT_SQL)
def _jsonl_roundtrip(spark, d):
    er = _er(spark, d)
    path = SK.write_jsonl(er, scratch_path(spark, "records") + "/records.jsonl")
    return _er_out(SRC.read_records(spark, path, schema=er.schema))


@reg("parquet_roundtrip", ER_OUT_SQL)
def _parquet_roundtrip(spark, d):
    path = SK.write_parquet(_er(spark, d), scratch_path(spark, "records") + "/records.parquet")
    return _er_out(SRC.read_structured(spark, path, "parquet"))


@reg("table_roundtrip", ER_OUT_SQL)
def _table_roundtrip(spark, d):
    name = "records_" + os.urandom(4).hex()
    SK.write_table(_er(spark, d), name, scratch_path(spark, "table"))
    return _er_out(spark.table(name))


@reg("publish_formats", ER_OUT_SQL)
def _publish_formats(spark, d):
    root = scratch_path(spark, "publish")
    out = SK.publish(_er(spark, d), root + "/processed", root + "/final", ["jsonl", "csv", "parquet"])
    return _er_out(spark.read.parquet(out["final_parquet"]))


@reg("csv_roundtrip", f"WITH {O.DR} SELECT " + ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" for c in ["entity_id", "doc_id", "text", "lang", "source", "n_chars", "quality",
                                              "toxic", "content_hash"]) + " FROM dr")
def _csv_roundtrip(spark, d):
    path = SK.write_csv(_dr(spark, d), scratch_path(spark, "records") + "/records.csv")
    return SRC.read_records(spark, path)


@reg("url_list", "SELECT url FROM pages")
def _url_list(spark, d):
    path = scratch_path(spark, "urls") + "/urls.csv"
    load(spark, d, "pages").select("url").write.option("header", True).csv(path)
    return SRC.read_url_list(spark, path, "url").select("url")


@reg("archive_roundtrip", "SELECT 'raw/' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 10), "
     "'%Y-%m-%dT%H%M%SZ0000') || '_' || substr(sha256(html), 1, 16) || '.html' AS raw_file_path, 'ok' AS status, "
     "'[redacted]' AS cookie FROM pages")
def _archive_roundtrip(spark, d):
    arch = with_archive_paths(archive_from_pages(load(spark, d, "pages")), "raw")
    arch = arch.withColumn("headers", F.map_concat("headers", F.create_map(F.lit("Set-Cookie"), F.lit("sid=1"))))
    path = scratch_path(spark, "archive")
    for part, batch in ((arch.where("page_id % 2 = 0"), "even"), (arch.where("page_id % 2 = 1"), "odd"), (arch, "even")):
        SK.write_archive(part, path, batch)  # a batch that comes again changes nothing
    stored = SK.read_archive_table(spark, path)
    checked = J.verify_archive(stored, stored.select(F.col("raw_file_path").alias("path"), F.col("body").alias("content")))
    return checked.join(stored.select("raw_file_path", F.col("headers")["Set-Cookie"].alias("cookie")), "raw_file_path") \
        .select("raw_file_path", "status", "cookie")


# ---------------------------------------------------------------- streaming (STR-*)

@reg("stream_archive", "SELECT event_id FROM events")
def _stream_archive(spark, d):
    sink, ck = scratch_path(spark, "stream-archive"), scratch_path(spark, "stream-ck")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    for _ in range(2):  # the second run resumes from the checkpoint and ingests nothing twice
        ST.stream_archive(spark, d, schema, sink, ck, ts="ts", glob="events.parquet").awaitTermination()
    return spark.read.parquet(sink).select("event_id")


@reg("stream_dedup", "SELECT DISTINCT 'https://u' || CAST(user_id AS VARCHAR) || '.example.com/' AS source_url, "
     "sha256(event_type) AS content_hash FROM events")
def _stream_dedup(spark, d):
    src = ST.table_stream(spark, d, "events").select(
        F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.com/")).alias("source_url"),
        R.content_hash("event_type").alias("content_hash"), "ts")
    path = ST.run_to_table(ST.stream_dedup(src, "ts", ["source_url", "content_hash"]),
                           scratch_path(spark, "stream-dedup"), scratch_path(spark, "stream-ck"))
    return spark.read.parquet(path).select("source_url", "content_hash")


@reg("stream_health", "WITH b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ws, event_type AS status, count(*) AS n "
     "FROM events GROUP BY 1, 2) SELECT strftime(ws, '%Y-%m-%d %H:%M:%S.%f') AS window_start, "
     "strftime(ws + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS window_end, status, n FROM b "
     "WHERE ws + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def _stream_health(spark, d):
    src = ST.table_stream(spark, d, "events")
    path = ST.run_to_table(ST.stream_health(src, "ts", "event_type"), scratch_path(spark, "stream-health"),
                           scratch_path(spark, "stream-ck"))
    out = spark.read.parquet(path)
    return out.select(ts("window.start").alias("window_start"), ts("window.end").alias("window_end"), "status", "n")


@reg("stream_changes", "SELECT CAST(user_id AS VARCHAR) AS entity, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, "
     "h AS content_hash, prev AS prev_hash, CASE WHEN prev IS NULL THEN 'new' ELSE 'changed' END AS change FROM "
     "(SELECT user_id, ts, sha256(event_type) AS h, lag(sha256(event_type)) OVER (PARTITION BY user_id ORDER BY ts, "
     "event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> h")
def _stream_changes(spark, d):
    src = ST.table_stream(spark, d, "events").withColumn("h", R.content_hash("event_type"))
    with ST.rocksdb_state(spark):
        path = ST.run_to_table(ST.stream_changes(src, "user_id", "ts", "h", tiebreak="event_id"),
                               scratch_path(spark, "stream-changes"), scratch_path(spark, "stream-ck"))
    out = spark.read.parquet(path)
    return out.select("entity", ts("ts").alias("ts"), "content_hash", "prev_hash", "change")


# Three arrivals of the events: by ten-day span, every 20th event one arrival late.
WAVES_CTE = (f"w0 AS (SELECT *, least(CAST(floor((extract(day FROM ts) - 1) / 10) AS INTEGER), 2) AS span FROM events), "
             "wv AS (SELECT *, CASE WHEN event_id % 20 = 0 AND span < 2 THEN span + 1 ELSE span END AS wave FROM w0)")


def _waves(spark, d):
    span = F.least(F.floor((F.dayofmonth("ts") - 1) / 10).cast("int"), F.lit(2))
    late = F.when((F.col("event_id") % 20 == 0) & (span < 2), span + 1).otherwise(span)
    ev = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("wave", late)
    return [ev.filter(F.col("wave") == i) for i in range(3)]


@reg("stream_changes_waves", f"WITH {WAVES_CTE}, f AS (SELECT *, max((ts, event_id)) OVER (PARTITION BY user_id "
     "ORDER BY wave RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM wv), "
     "k AS (SELECT user_id, ts, sha256(event_type) AS h, lag(sha256(event_type)) OVER (PARTITION BY user_id "
     "ORDER BY ts, event_id) AS prev FROM f WHERE known IS NULL OR (ts, event_id) > known) "
     "SELECT CAST(user_id AS VARCHAR) AS entity, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, h AS content_hash, "
     "prev AS prev_hash, CASE WHEN prev IS NULL THEN 'new' ELSE 'changed' END AS change FROM k "
     "WHERE prev IS NULL OR prev <> h")
def _stream_changes_waves(spark, d):  # STR-4 over three arrivals, with late rows
    with ST.rocksdb_state(spark):
        path = ST.run_waves(_waves(spark, d), scratch_path(spark, "arrivals") + "/events",
                            lambda s: ST.stream_changes(s.withColumn("h", R.content_hash("event_type")),
                                                        "user_id", "ts", "h", tiebreak="event_id"),
                            scratch_path(spark, "stream-changes"), scratch_path(spark, "stream-ck"))
    return spark.read.parquet(path).select("entity", ts("ts").alias("ts"), "content_hash", "prev_hash", "change")


# The three arrivals 40 days further apart; every third user's second span comes with the first, so that
# nothing is seen of them for longer than state is kept.
QUIET_CTE = ("w0 AS (SELECT *, least(CAST(floor((extract(day FROM ts) - 1) / 10) AS INTEGER), 2) AS span FROM events), "
             "w1 AS (SELECT * REPLACE (CASE WHEN user_id % 3 = 1 AND span = 1 THEN 0 ELSE span END AS span) FROM w0), "
             "wv AS (SELECT * REPLACE (ts + to_days(40 * span) AS ts), CASE WHEN event_id % 20 = 0 AND span < 2 "
             "THEN span + 1 ELSE span END AS wave FROM w1), "
             "mark AS (SELECT wave, date_trunc('milliseconds', max(max(ts)) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED "
             "PRECEDING AND 1 PRECEDING)) - to_days(30) AS mark FROM wv GROUP BY wave), "
             "seen AS (SELECT wv.*, mark FROM wv JOIN mark USING (wave) WHERE mark IS NULL OR ts > mark)")


def _quiet_waves(spark, d):
    span = F.least(F.floor((F.dayofmonth("ts") - 1) / 10).cast("int"), F.lit(2))
    ev = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ev = ev.withColumn("span", F.when((F.col("user_id") % 3 == 1) & (span == 1), 0).otherwise(span))
    late = F.when((F.col("event_id") % 20 == 0) & (F.col("span") < 2), F.col("span") + 1).otherwise(F.col("span"))
    ev = ev.withColumn("wave", late).withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.col("span") * 40)).drop("span")
    return [ev.filter(F.col("wave") == i) for i in range(3)]


@reg("stream_changes_expiry", f"WITH {QUIET_CTE}, f AS (SELECT *, max((ts, event_id)) OVER (PARTITION BY user_id ORDER BY "
     "wave RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS place FROM seen), "
     "g AS (SELECT *, CASE WHEN mark IS NULL OR date_trunc('milliseconds', place[1]) > mark THEN place END AS known FROM f), "
     "k AS (SELECT user_id, ts, sha256(event_type) AS h, CASE WHEN known IS NOT NULL OR row_number() OVER (PARTITION BY user_id, "
     "wave ORDER BY ts, event_id) > 1 THEN lag(sha256(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS prev "
     "FROM g WHERE known IS NULL OR (ts, event_id) > known) "
     "SELECT CAST(user_id AS VARCHAR) AS entity, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, h AS content_hash, "
     "prev AS prev_hash, CASE WHEN prev IS NULL THEN 'new' ELSE 'changed' END AS change FROM k WHERE prev IS NULL OR prev <> h")
def _stream_changes_expiry(spark, d):  # STR-4: entities unseen for 30 days are new again
    with ST.rocksdb_state(spark):
        path = ST.run_waves(_quiet_waves(spark, d), scratch_path(spark, "arrivals") + "/events",
                            lambda s: ST.stream_changes(s.withColumn("h", R.content_hash("event_type")),
                                                        "user_id", "ts", "h", tiebreak="event_id"),
                            scratch_path(spark, "stream-changes"), scratch_path(spark, "stream-ck"))
    return spark.read.parquet(path).select("entity", ts("ts").alias("ts"), "content_hash", "prev_hash", "change")


@reg("stream_dedup_waves", f"WITH {WAVES_CTE}, p AS (SELECT 'https://u' || CAST(user_id AS VARCHAR) || '.example.com/' "
     "AS source_url, sha256(event_type) AS content_hash, bool_or(wave = 0) AS p0, bool_or(wave = 1) AS p1, "
     "bool_or(wave = 2) AS p2 FROM wv GROUP BY 1, 2) SELECT source_url, content_hash, 0 AS wave FROM p WHERE p0 "
     "UNION ALL SELECT source_url, content_hash, 1 FROM p WHERE p1 AND NOT p0 "
     "UNION ALL SELECT source_url, content_hash, 2 FROM p WHERE p2 AND NOT (p1 AND NOT p0)")
def _stream_dedup_waves(spark, d):
    """STR-2 over three crawls a day apart: a copy is dropped while the first
    one is in state, which is until the watermark passes it by an hour."""
    crawl = F.make_timestamp(F.lit(2024), F.lit(1), F.col("wave") + 1, F.lit(0), F.lit(0), F.lit(0))
    waves = [w.select(F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.com/"))
                      .alias("source_url"), R.content_hash("event_type").alias("content_hash"), "wave",
                      crawl.alias("fetched_at")) for w in _waves(spark, d)]
    path = ST.run_waves(waves, scratch_path(spark, "arrivals") + "/events",
                        lambda s: ST.stream_dedup(s, "fetched_at", ["source_url", "content_hash"]),
                        scratch_path(spark, "stream-dedup"), scratch_path(spark, "stream-ck"))
    return spark.read.parquet(path).select("source_url", "content_hash", "wave")


# ---------------------------------------------------------------- rows that the tables lack, derived from them

# Nation names misspelled by customer: capitals, blanks at the ends, a blank inside, missing, unknown.
SPELLED_CTE = ("sp AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN lower(n_name) WHEN 1 THEN ' ' || n_name "
               "WHEN 2 THEN left(n_name, 2) || ' ' || substr(n_name, 3) WHEN 3 THEN NULL WHEN 4 THEN 'Atlantis' "
               "ELSE n_name END AS region FROM customer JOIN nation ON c_nationkey = n_nationkey)")


def _spelled(spark, d):
    n, kind = F.col("n_name"), F.col("c_custkey") % 7
    region = (F.when(kind == 0, F.lower(n)).when(kind == 1, F.concat(F.lit(" "), n))
              .when(kind == 2, F.concat(F.substring(n, 1, 2), F.lit(" "), F.expr("substring(n_name, 3)")))
              .when(kind == 3, F.lit(None)).when(kind == 4, F.lit("Atlantis")).otherwise(n))
    return (load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", region.alias("region")))


@reg("region_variants_spelled", f"WITH {SPELLED_CTE}, x AS (SELECT DISTINCT replace(lower(trim(region)), ' ', '') AS "
     "normalized, region AS variant FROM sp WHERE region IS NOT NULL), y AS (SELECT normalized, count(*) AS spellings "
     "FROM x GROUP BY 1 HAVING count(*) > 1) SELECT x.normalized, x.variant, y.spellings FROM x JOIN y USING (normalized)")
def _region_variants_spelled(spark, d):  # AGG-12
    return Q.region_variants(_spelled(spark, d), "region")


@reg("unmatched_regions_spelled", f"WITH {SPELLED_CTE} SELECT c_custkey, region, CASE WHEN region IS NULL THEN 'missing' "
     "ELSE 'unknown' END AS reason FROM sp WHERE region IS NULL OR region NOT IN (SELECT n_name FROM nation)")
def _unmatched_regions_spelled(spark, d):  # JN-7
    return J.unmatched_regions(_spelled(spark, d), "region", load(spark, d, "nation"), "n_name")


@reg("extract_months_links", "SELECT event_id, unnest(list_sort(list_distinct([strftime(ts, '%Y%m'), "
     "strftime(ts - to_months(CAST(user_id % 2 AS INTEGER)), '%Y%m')]))) AS month FROM events")
def _extract_months_links(spark, d):  # EXT-6 over index pages written from the events; '&amp;' links do not count
    link = lambda m, amp="&": F.concat(F.lit("<a href='daydata.php?city="), F.col("user_id").cast("string"),
                                       F.lit(f"{amp}month="), m, F.lit("'>x</a>"))
    month = F.date_format("ts", "yyyyMM")
    past = F.date_format(F.col("ts") - F.make_ym_interval(F.lit(0), (F.col("user_id") % 2).cast("int")), "yyyyMM")
    page = load(spark, d, "events").select("event_id", F.concat(
        link(month), link(past), link(F.lit("199901"), "&amp;")).alias("html"))
    return API.extract_months(page, "html").select("event_id", F.explode("months").alias("month"))


# Titles and texts of documents, some blank, blocked or made of one shared line.
NOTED_TITLE = "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' || chr(10) ELSE 'Document ' || CAST(doc_id AS VARCHAR) END"
NOTED_TEXT = ("CASE doc_id % 7 WHEN 0 THEN 'Please solve the CAPTCHA' WHEN 1 THEN text || chr(10) || '访问被拒绝' "
              "WHEN 2 THEN 'Terms of use' WHEN 3 THEN ' Terms  of use' ELSE 'Terms of use' || chr(10) || text END")


@reg("flag_text_noted", f"WITH documents AS (SELECT doc_id, source, {NOTED_TITLE} AS title, {NOTED_TEXT} AS text FROM "
     f"read_docs), {O.doc_lines(0.5)} SELECT dd.doc_id, (dd.title IS NULL OR trim(regexp_replace(dd.title, "
     f"{O.lit(O.WS)}, ' ', 'g')) = '') AS empty_title, {O.blocked('dd.text')} AS blocked, "
     "(coalesce(p.n_lines, 0) > 0 AND p.n_lines = p.n_bp) AS boilerplate_only, coalesce(g.pages >= 3, false) AS judged "
     "FROM documents dd LEFT JOIN per_key p ON dd.doc_id = p.key LEFT JOIN per_group g ON dd.source = g.grp".replace("documents", "noted").replace("read_docs", "documents"))
def _flag_text_noted(spark, d):  # FLT-5 with every flag both ways
    k5, k7, terms = F.col("doc_id") % 5, F.col("doc_id") % 7, F.lit("Terms of use")
    title = (F.when(k5 == 0, F.lit(None)).when(k5 == 1, F.lit(" \n"))
             .otherwise(F.concat(F.lit("Document "), F.col("doc_id").cast("string"))))
    text = (F.when(k7 == 0, F.lit("Please solve the CAPTCHA")).when(k7 == 1, F.concat_ws("\n", "text", F.lit("访问被拒绝")))
            .when(k7 == 2, terms).when(k7 == 3, F.lit(" Terms  of use")).otherwise(F.concat_ws("\n", terms, "text")))
    noted = load(spark, d, "documents").select("doc_id", "source", title.alias("title"), text.alias("text"))
    return FL.flag_text(noted, "doc_id", "source", "title", "text")


@reg("flag_price_text", "WITH t AS (SELECT o_orderkey, o_orderpriority AS cat, CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 "
     "THEN -o_totalprice WHEN 2 THEN o_totalprice * 100 ELSE o_totalprice END AS price FROM (SELECT * REPLACE "
     "(CAST(o_totalprice AS DECIMAL(18, 2)) AS o_totalprice) FROM orders)), st AS (SELECT cat, quantile_disc(price, 0.25) "
     "AS q1, quantile_disc(price, 0.75) AS q3 FROM t GROUP BY 1) SELECT o_orderkey, price IS NULL AS unparseable, "
     "coalesce(price < 0, false) AS negative, coalesce(price < q1 - 3 * (q3 - q1) OR price > q3 + 3 * (q3 - q1), false) "
     "AS outlier FROM t LEFT JOIN st ON t.cat IS NOT DISTINCT FROM st.cat")
def _flag_price_text(spark, d):  # FN-12 + FLT-6: price texts, some without a number, negative or extreme
    k, price = F.col("o_orderkey") % 11, F.col("o_totalprice").cast("decimal(18,2)")
    value = F.when(k == 1, -price).when(k == 2, price * 100).otherwise(price).cast("decimal(18,2)")
    text = F.when(k == 0, F.lit("面议")).otherwise(F.concat(F.lit("¥"), value.cast("string"), F.lit("/件")))
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", TX.parse_amount(text)["amount"].alias("price"))
    return FL.flag_price(o, "price", "o_orderpriority").select("o_orderkey", "unparseable", "negative", "outlier")


@reg("verify_archive_damaged", "SELECT 'raw/' || CAST(page_id AS VARCHAR) AS raw_file_path, CASE page_id % 9 WHEN 0 THEN "
     "'missing_file' WHEN 1 THEN 'altered' WHEN 2 THEN 'unrecorded' ELSE 'ok' END AS status FROM pages")
def _verify_archive_damaged(spark, d):  # JN-9 with every status
    k = F.col("page_id") % 9
    p = load(spark, d, "pages").select(F.concat(F.lit("raw/"), F.col("page_id").cast("string")).alias("raw_file_path"),
                                       "html", k.alias("k"))
    recorded = p.filter("k <> 2").select("raw_file_path", R.content_hash("html").alias("content_hash"))
    stored = p.filter("k <> 0").select(F.col("raw_file_path").alias("path"), F.encode(
        F.when(F.col("k") == 1, F.concat("html", F.lit(" "))).otherwise(F.col("html")), "UTF-8").alias("content"))
    return J.verify_archive(recorded, stored).select("raw_file_path", "status")


@reg("batch_extract_attempts", "WITH a AS (SELECT *, 'https://u' || CAST(user_id AS VARCHAR) || '.example.com/' AS u, "
     "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS st, sha256(props) AS h, "
     "date_trunc('hour', ts) AS fetched FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY "
     "(st BETWEEN 200 AND 299) DESC, fetched DESC, h DESC) AS rn FROM a), r AS (SELECT c_custkey AS seq, 'https://u' || "
     "CAST(c_custkey % 300 AS VARCHAR) || '.example.com/' AS u FROM customer) SELECT r.seq, r.u AS source_url, "
     "b.st AS status_code, b.h AS content_hash FROM r LEFT JOIN b ON r.u = b.u AND b.rn = 1")
def _batch_extract_attempts(spark, d):  # JN-1 over an archive with several attempts a URL, one record a request
    site = lambda c: F.concat(F.lit("https://u"), c.cast("string"), F.lit(".example.com/"))
    arch = load(spark, d, "events").select(site(F.col("user_id")).alias("source_url"), F.when(
        F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), R.content_hash("props").alias("content_hash"),
        F.date_trunc("hour", "ts").alias("fetched_at"))
    req = load(spark, d, "customer").select(F.col("c_custkey").alias("seq"), site(F.col("c_custkey") % 300).alias("url"))
    return J.batch_extract(req, arch).select("seq", "source_url", "status_code", "content_hash")


def _shipping(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: fn for k, (fn, _) in _REG.items()}
    if LLM:
        out |= {**LLM.QUERIES, "pipeline": PIPELINE.run}
    return {k: _shipping(fn) for k, fn in out.items()}


def oracle_sql() -> dict[str, str]:
    out = {k: sql for k, (_, sql) in _REG.items() if sql}
    out["safe_columns"] = O.safe_columns_sql()
    if LLM:
        out |= LLM.ORACLE_SQL
        if PIPELINE.ORACLE_SQL:
            out["pipeline"] = PIPELINE.ORACLE_SQL
    return out
