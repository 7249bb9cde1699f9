"""Nested API documents (SRC-5) and their observations (EXT-6, EXT-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions._util import col_of, qcol

# Item fields of the API's answer; read as text, typed later with try_cast.
ITEM_FIELDS = ["time_point", "aqi", "quality", "pm2_5", "pm10", "so2", "no2", "co", "o3", "rank"]
API_SCHEMA = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("errmsg", T.StringType()),
    T.StructField("result", T.StructType([
        T.StructField("data", T.StructType([
            T.StructField("items", T.ArrayType(T.StructType(
                [T.StructField(f, T.StringType()) for f in ITEM_FIELDS]))),
        ])),
    ])),
])

# Fixed value: the message of an answer without items, as records carry it.
NO_ITEMS = "API returned no day-level items"
# Fixed value: the address form of links to a city's days.
DAY_LINK = r"daydata\.php\?city=[^\"'&<>]+&month=(\d{6})"


def parse_api_documents(df: DataFrame, json_col: str, out: str = "doc") -> DataFrame:
    """SRC-5: decoded API JSON -> typed struct. A wrong-typed ``result`` /
    ``data`` / ``items`` degrades to null (treated as empty), never fails;
    ``success`` is true only for the JSON boolean ``true``."""
    return df.withColumn(out, F.from_json(qcol(json_col), API_SCHEMA, {"mode": "PERMISSIVE"}))


def observations_from_api(docs: DataFrame, doc: str, city: str, month: str,
                          source: str, keep: list[str] | None = None) -> DataFrame:
    """EXT-7: one row per item when ``success`` is true and the item list is
    non-empty (status 'ok'); otherwise exactly one placeholder row with blank
    measures, status 'no_items' and ``extraction_errors`` = errmsg or a
    default text. One pass: ``explode_outer`` over the usable items."""
    keep = keep or []
    d = F.col(doc)
    items = F.when(d["success"].eqNullSafe(True) & (F.size(F.coalesce(d["result"]["data"]["items"],
                   F.array())) > 0), d["result"]["data"]["items"])
    exploded = docs.select(*[qcol(k) for k in keep], col_of(city).alias("城市"), col_of(month).alias("月份"),
                           d["errmsg"].alias("__errmsg"), F.explode_outer(items).alias("__it"))
    ok = F.col("__it").isNotNull()
    blank = F.lit("")
    item = lambda f: F.when(ok, F.coalesce(F.col("__it")[f], blank)).otherwise(blank)
    eid = F.when(ok, F.concat_ws(":", F.lit(source), F.col("城市"), item("time_point"))) \
           .otherwise(F.concat_ws(":", F.lit(source), F.col("城市"), F.col("月份"), F.lit("no_data")))
    err = F.when(ok, F.lit(None)).otherwise(F.coalesce(F.col("__errmsg"), F.lit(NO_ITEMS)))
    return exploded.select(
        eid.alias("entity_id"), "城市", "月份", item("time_point").alias("日期"),
        item("aqi").alias("AQI"), item("quality").alias("质量等级"), item("pm2_5").alias("PM2.5"),
        item("pm10").alias("PM10"), item("so2").alias("SO2"), item("no2").alias("NO2"),
        item("co").alias("CO"), item("o3").alias("O3"), item("rank").alias("排名"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("no_items")).alias("数据状态"),
        err.alias("extraction_errors"), *[qcol(k) for k in keep])


def extract_months(df: DataFrame, html: str, out: str = "months") -> DataFrame:
    """EXT-6: every ``month=YYYYMM`` of day-data links, distinct, sorted.
    '&amp;month=' does not match (the separator must be a bare '&')."""
    found = F.regexp_extract_all(qcol(html), F.lit(DAY_LINK), 1)
    return df.withColumn(out, F.array_sort(F.array_distinct(found)))
