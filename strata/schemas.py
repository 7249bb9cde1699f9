"""Declared schemas: archive rows, provenance and the five research datasets."""

from __future__ import annotations

from pyspark.sql import types as T

ARCHIVE = T.StructType([
    T.StructField("source_url", T.StringType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("body", T.BinaryType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("fetcher_name", T.StringType()),
])

# Provenance columns every record carries.
PROVENANCE = ["source_url", "final_url", "fetched_at", "status_code", "content_hash",
              "raw_file_path", "extractor_name", "extractor_version"]

# Provenance columns of the city-day API recipe, in order.
API_PROVENANCE = ["source_url", "final_url", "page_url", "fetched_at", "status_code",
                  "content_hash", "raw_file_path", "page_raw_file_path", "metadata_file_path",
                  "extractor_name", "extractor_version", "api_method"]

_S, _TS, _D, _M = T.StringType(), T.TimestampType(), T.DateType(), T.DecimalType(18, 2)

# Documented dataset columns (names as the rules give them).
DATASETS: dict[str, list[tuple[str, T.DataType]]] = {
    "price": [("entity_id", _S), ("observed_at", _TS), ("商品名称", _S), ("价格", _M), ("币种", _S),
              ("单位", _S), ("地区", _S), ("平台", _S), ("source_url", _S)],
    "housing": [("entity_id", _S), ("observed_at", _TS), ("标题", _S), ("总价", _M), ("单价", _M),
                ("面积", T.DoubleType()), ("户型", _S), ("小区", _S), ("区县", _S), ("城市", _S),
                ("source_url", _S)],
    "jobs": [("entity_id", _S), ("observed_at", _TS), ("职位名称", _S), ("公司", _S), ("薪资", _S),
             ("城市", _S), ("经验要求", _S), ("学历要求", _S), ("发布日期", _D), ("source_url", _S)],
    "announcements": [("entity_id", _S), ("发布日期", _D), ("标题", _S), ("发布机构", _S), ("地区", _S),
                      ("公告类型", _S), ("正文", _S), ("source_url", _S)],
    "air_quality": [("entity_id", _S), ("observed_at", _TS), ("城市", _S), ("月份", _S), ("日期", _D),
                    ("AQI", T.IntegerType()), ("质量等级", _S), ("PM2.5", T.DoubleType()),
                    ("PM10", T.DoubleType()), ("SO2", T.DoubleType()), ("NO2", T.DoubleType()),
                    ("CO", T.DoubleType()), ("O3", T.DoubleType()), ("source_url", _S)],
}
