"""City-day panel flow (survey 3.3) over API-style documents.

Documents are derived from ``events`` by Spark, one response per event:
error events are failed responses (``success`` false, an errmsg), signup
events answer with an empty item list, every other event carries one
day-level item. The JSON text is then parsed back (SRC-5) and turned into
observations (EXT-7): row-wise, so the work grows with the events and no
group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.records import content_hash
from strata.functions.urls import build_url
from strata.operators.columns import stamp_provenance
from strata.operators.filters import fallback_short_page
from strata.operators.quality import latest_month
from strata.sources.api import extract_months, observations_from_api, parse_api_documents

UPSTREAM_ERROR = "upstream error"
SOURCE = "city-api"  # first part of the entity ids


def api_documents(events: DataFrame) -> DataFrame:
    item = F.struct(
        F.date_format("ts", "yyyy-MM-dd").alias("time_point"),
        F.get_json_object("props", "$.k").alias("aqi"),
        F.col("event_type").alias("quality"),
        F.col("value").cast("string").alias("pm2_5"),
        F.col("user_id").cast("string").alias("rank"),
    )
    items = (F.when(F.col("event_type") == "signup", F.array().cast("array<struct<time_point:string,aqi:string,"
                                                                       "quality:string,pm2_5:string,rank:string>>"))
             .otherwise(F.array(item)))
    doc = F.struct(
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", F.lit(UPSTREAM_ERROR)).alias("errmsg"),
        F.struct(F.struct(items.alias("items")).alias("data")).alias("result"),
    )
    return events.select(
        "event_id", F.col("user_id").cast("string").alias("city"),
        F.date_format("ts", "yyyyMM").alias("month"), F.to_json(doc).alias("body_text"))


def api_observations(events: DataFrame) -> DataFrame:
    """SRC-5 + EXT-7 over every derived document."""
    docs = parse_api_documents(api_documents(events), "body_text")
    return observations_from_api(docs, "doc", "city", "month", SOURCE, keep=["event_id"])


def assemble_panel(events: DataFrame, requested_month: str = "latest",
                   as_of: str = "2024-02-01") -> DataFrame:
    """JN-3 + AGG-11: cities -> months available per city -> chosen month
    -> that month's documents -> observations (multi-way equi join on
    (city, month); the month choice is a per-city aggregate). A city
    without a document for its month keeps one 'no_items' row."""
    docs = api_documents(events)
    months = docs.select("city", "month").distinct()
    chosen = latest_month(months, "city", "month", requested_month, as_of)
    picked = chosen.join(docs, ["city", "month"], "left")
    parsed = parse_api_documents(picked, "body_text")
    return observations_from_api(parsed, "doc", "city", "month", SOURCE, keep=["event_id"])


MONTH_URL, DAY_URL = "https://www.example.com/monthdata.php", "https://www.example.com/daydata.php"
API_URL = "https://api.example.com/history"
DAY_ROW = "<tr><td>one record of this month</td></tr>"


def month_pages(events: DataFrame) -> DataFrame:
    """``(city, url, html, raw_file_path)``: a page a city, linking its months."""
    months = events.select(F.col("user_id").cast("string").alias("city"), F.date_format("ts", "yyyyMM").alias("month")).distinct()
    link = F.concat(F.lit('<a href="daydata.php?city='), "city", F.lit("&month="), "month", F.lit('">'), "month", F.lit("</a>"))
    return months.groupBy("city").agg(F.concat_ws("\n", F.sort_array(F.collect_list(link))).alias("html")).select(
        "city", build_url(F.lit(MONTH_URL), {"city": F.col("city")}).alias("url"), "html",
        F.concat(F.lit("raw/month/"), "city", F.lit(".html")).alias("raw_file_path"))


def day_pages(events: DataFrame) -> DataFrame:
    """``(city, month, url, html, raw_file_path)``: a page a city and month,
    as long as the month has records."""
    counts = events.groupBy(F.col("user_id").cast("string").alias("city"), F.date_format("ts", "yyyyMM").alias("month")).count()
    rows = F.expr(f"repeat('{DAY_ROW}', cast(count as int))")
    return counts.select(
        "city", "month", build_url(F.lit(DAY_URL), {"city": F.col("city"), "month": F.col("month")}).alias("url"),
        F.concat(F.lit("<table>"), rows, F.lit("</table>")).alias("html"),
        F.concat(F.lit("raw/day/"), "city", F.lit("_"), "month", F.lit(".html")).alias("raw_file_path"))


def api_responses(events: DataFrame) -> DataFrame:
    """:func:`api_documents` with the metadata of their requests."""
    asked = events.select(
        "event_id", F.col("ts").cast("timestamp").alias("fetched_at"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"))
    url = build_url(F.lit(API_URL), {"city": F.col("city"), "month": F.col("month")})
    return api_documents(events).join(asked, "event_id").select(
        "*", url.alias("source_url"), url.alias("final_url"), content_hash("body_text").alias("content_hash"),
        F.concat(F.lit("raw/api/"), F.col("event_id").cast("string"), F.lit(".json")).alias("raw_file_path"),
        F.concat(F.lit("meta/api/"), F.col("event_id").cast("string"), F.lit(".json")).alias("metadata_file_path"))


API_META = ["source_url", "final_url", "fetched_at", "status_code", "content_hash", "raw_file_path", "metadata_file_path"]


def panel_records(months: DataFrame, days: DataFrame, api: DataFrame, requested_month: str = "latest",
                  as_of: str = "2024-02-01", min_chars: int = 1000, keep: tuple[str, ...] = (),
                  extractor: tuple[str, str, str] = ("history-api", "0.1.0", "getHistory")) -> DataFrame:
    """The city-day chain with its lineage: month page -> months it links
    (EXT-6) -> chosen month (AGG-11) -> day page, or the month page where the
    day page is missing or short (FLT-4) -> API responses of that city and
    month -> observations (EXT-7), each with the 12 provenance columns of its
    API response and its page (PRJ-6), and ``used_fallback``.

    ``months(city, url, html, raw_file_path)`` has a row a city,
    ``days(city, month, ...)`` at most one a city and month, ``api(city, month,
    body_text, API_META, keep)`` any number. A city whose month no response
    answers keeps one 'no_items' row, with its page and no request. Page texts
    are read where they are: links and lengths go on, bodies cross no shuffle.
    Responses are the rows an inner join splits, so a city with a third of them
    spans many tasks.
    """
    listed = extract_months(months, "html").select(
        "city", F.explode_outer("months").alias("month"))
    chosen = latest_month(listed, "city", "month", requested_month, as_of)
    city_page = months.select("city", F.col("url").alias("__url"), F.col("raw_file_path").alias("__path"))
    page = days.select("city", "month", F.col("url").alias("page_url"), F.col("raw_file_path").alias("page_raw_file_path"),
                       F.length("html").alias("__chars"))
    paged = chosen.join(city_page, "city").join(page, ["city", "month"], "left") \
        .withColumn("__chars", F.coalesce("__chars", F.lit(0)))
    paged = fallback_short_page(paged, None, ["page_url", "page_raw_file_path"], ["__url", "__path"], min_chars, chars="__chars")
    paged = paged.select("city", "month", "page_url", "page_raw_file_path", "used_fallback")
    asked = api.select("city", "month", "body_text", *API_META, *keep)
    answered = asked.join(paged, ["city", "month"])
    silent = paged.join(asked.select("city", "month").distinct(), ["city", "month"], "left_anti")
    rows = parse_api_documents(answered.unionByName(silent, allowMissingColumns=True), "body_text")
    obs = observations_from_api(rows, "doc", "city", "month", SOURCE,
                                keep=[*API_META, "page_url", "page_raw_file_path", "used_fallback", *keep])
    return stamp_provenance(obs, {c: F.col(c) for c in API_META}, F.col("page_raw_file_path"), F.col("page_url"), *extractor)


def panel_lineage_dataset(events: DataFrame, processed_dir: str, final_dir: str | None, language: str | None = None,
                          formats: tuple[str, ...] = ("parquet",), stem: str = "panel") -> tuple[DataFrame, dict]:
    """:func:`panel_records` over the pages and responses of ``events``,
    localized (names stay without a ``language``), published and audited as in
    :func:`panel_dataset`."""
    from strata.operators.columns import localize_columns
    from strata.plans.flows import quality_report
    from strata.sinks.writers import publish
    records = panel_records(month_pages(events), day_pages(events), api_responses(events), keep=("event_id",))
    named = localize_columns(records, language) if language else records
    out = publish(named, processed_dir, final_dir, list(formats), stem=stem)
    published = events.sparkSession.read.parquet(out["parquet"]) if "parquet" in out else named
    return published, quality_report(published)


def panel_dataset(events: DataFrame, processed_dir: str, final_dir: str | None,
                  requested: list[str] | None = None, language: str = "en",
                  formats: tuple[str, ...] = ("jsonl", "csv", "parquet"), stem: str = "panel",
                  requested_month: str = "latest", as_of: str = "2024-02-01") -> tuple[DataFrame, dict]:
    """The whole city-day flow: panel -> requested columns -> localized
    names -> published in every format to the processed and final folders
    -> audit tables. Returns the published dataset (read from its Parquet
    export, so the report does not compute the panel again) and the report."""
    from strata.operators.columns import localize_columns, project_columns
    from strata.plans.flows import quality_report
    from strata.sinks.writers import publish
    obs = assemble_panel(events, requested_month, as_of)
    ds = localize_columns(project_columns(obs, requested), language)
    out = publish(ds, processed_dir, final_dir, list(formats), stem=stem)
    published = events.sparkSession.read.parquet(out["parquet"]) if "parquet" in out else ds
    return published, quality_report(published)
