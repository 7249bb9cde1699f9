"""Quality audit: missing values, duplicates, status, errors, notes (AGG-*, FLT-2/3).

Every audit is one or two aggregation passes. Aggregations are partial
first (map-side), so a hot key or hot host costs one partial row per task.
Nothing is collected to the driver; reports are small DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions._util import qcol

# Alternative (English / Chinese) names of the audited fields.
ENTITY_FIELDS = ["entity_id", "实体ID"]
HASH_FIELDS = ["content_hash", "内容哈希"]
STATUS_FIELDS = ["status_code", "状态码"]
ERROR_FIELDS = ["error", "错误", "extraction_errors", "抽取错误"]


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_missing(df: DataFrame, name: str) -> Column:
    """FLT-2: null, '' or an empty list (by column type)."""
    c, t = qcol(name), _dtype(df, name)
    if isinstance(t, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(t, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def _present(df: DataFrame, name: str) -> Column:
    """Value counts as present for 'first value' (not null, not '')."""
    c, t = qcol(name), _dtype(df, name)
    return c.isNotNull() & (c != "") if isinstance(t, T.StringType) else c.isNotNull()


def _truthy(df: DataFrame, name: str) -> Column:
    c, t = qcol(name), _dtype(df, name)
    if isinstance(t, T.StringType):
        return c != ""
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.size(c) > 0
    if isinstance(t, T.BooleanType):
        return c
    return c != 0


def first_text(df: DataFrame, fields: list[str]) -> Column:
    """First present value among ``fields`` as text ('' when none)."""
    present = [f for f in fields if f in df.columns]
    if not present:
        return F.lit("")
    out = F.lit("")
    for f in reversed(present):
        val = qcol(f).cast("string") if not isinstance(_dtype(df, f), (T.ArrayType, T.MapType, T.StructType)) \
            else F.to_json(qcol(f))
        out = F.when(_present(df, f), val).otherwise(out)
    return out


def has_error(df: DataFrame, fields: list[str] = ERROR_FIELDS) -> Column:
    """FLT-3: the first present error field is truthy; an empty list found
    first hides later fields."""
    present = [f for f in fields if f in df.columns]
    out = F.lit(False)
    for f in reversed(present):
        out = F.when(_present(df, f), _truthy(df, f)).otherwise(out)
    return out


def extra_rows(df: DataFrame, key: Column) -> DataFrame:
    """Σ(count − 1) over groups with count > 1, for non-empty keys (AGG-3/4/5)."""
    return (df.select(key.alias("k")).filter((F.col("k").isNotNull()) & (F.col("k") != ""))
            .groupBy("k").count().filter("count > 1")
            .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("extra_rows")))


def duplicate_entities(df: DataFrame, fields: list[str] = ENTITY_FIELDS) -> DataFrame:
    """AGG-3: extra rows beyond the first per entity id."""
    return extra_rows(df, first_text(df, fields)).withColumnRenamed("extra_rows", "duplicate_entity_ids")


def shared_hash_rows(df: DataFrame, fields: list[str] = HASH_FIELDS) -> DataFrame:
    """AGG-4: extra rows sharing a content hash (informational)."""
    return extra_rows(df, first_text(df, fields)).withColumnRenamed("extra_rows", "shared_hash_rows")


def duplicates_by(df: DataFrame, key: str) -> DataFrame:
    """AGG-5: the same count for any key column, e.g. ``source_url``."""
    return extra_rows(df, qcol(key).cast("string")).withColumnRenamed("extra_rows", "duplicate_rows")


def record_summary(df: DataFrame) -> DataFrame:
    """AGG-1: records, fields, duplicate ids, shared-hash rows, error rows, in
    one scan: the extra rows of a key are its non-empty values less the
    distinct ones."""
    keyed = df.select(has_error(df).alias("err"), *[F.nullif(first_text(df, fields), F.lit("")).alias(name)
                                                    for name, fields in (("id", ENTITY_FIELDS), ("hash", HASH_FIELDS))])
    extra = lambda c: (F.count(c) - F.count_distinct(F.col(c))).cast("bigint")
    return keyed.agg(F.count(F.lit(1)).alias("records"), F.lit(len(df.columns)).cast("bigint").alias("fields"),
                     extra("id").alias("duplicate_entity_ids"), extra("hash").alias("shared_hash_rows"),
                     F.count_if("err").alias("error_records"))


def status_distribution(df: DataFrame, fields: list[str] = STATUS_FIELDS) -> DataFrame:
    """AGG-2: count per status as text; blank -> 'missing'; sorted by text
    (the sort runs on the one-row-per-status result only)."""
    s = first_text(df, fields)
    return (df.groupBy(F.when(s == "", F.lit("missing")).otherwise(s).alias("status"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("status"))


def missing_values(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """AGG-6: per field (sorted names): missing count and rate in percent.

    One aggregation pass computes every field's count, then an unpivot
    turns the single wide row into one row per field.
    """
    names = sorted(fields or df.columns)
    aggs = [F.count(F.lit(1)).alias("__n")] + [
        F.count_if(is_missing(df, n)).alias(f"__m{i}") for i, n in enumerate(names)]
    wide = df.agg(*aggs)
    stack = ", ".join(f"{_sql_str(n)}, `__m{i}`" for i, n in enumerate(names))
    long = wide.selectExpr("__n", f"stack({len(names)}, {stack}) AS (field, missing)")
    return long.select("field", F.col("missing").cast("bigint").alias("missing"),
                       F.when(F.col("__n") > 0, F.col("missing") * 100.0 / F.col("__n"))
                       .otherwise(F.lit(0.0)).alias("rate")).orderBy("field")


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def failure_counts(df: DataFrame, error_col: str = "error") -> DataFrame:
    """AGG-7: failed requests and extraction-error rows, by error text, per
    kind and overall (a rollup; ``level`` 0 = per text, 1 = per kind,
    3 = all)."""
    err = qcol(error_col) if error_col in df.columns else F.lit(None).cast("string")
    extraction = has_error(df, ["extraction_errors", "抽取错误"])
    kind = (F.when(err.isNotNull() & (err != ""), F.lit("failed_request"))
            .when(extraction, F.lit("extraction_error")))
    text = F.when(err.isNotNull() & (err != ""), err).otherwise(first_text(df, ["extraction_errors", "抽取错误"]))
    return (df.select(kind.alias("kind"), text.alias("error")).filter(F.col("kind").isNotNull())
            .rollup("kind", "error")
            .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level")))


# Note codes of the summary rule table, in rule order.
NOTE_RULES = ["errors", "duplicate_ids", "shared_hashes", "no_records", "all_clear"]


def quality_notes(summary: DataFrame) -> DataFrame:
    """AGG-8: rule table over a ``record_summary`` row -> note rows
    ``(rule, note, text)``; ``text`` is the figures the note rests on."""
    dirty = {"errors": "error_records", "duplicate_ids": "duplicate_entity_ids", "shared_hashes": "shared_hash_rows"}
    figure = lambda c: F.concat(F.lit(f"{c}="), F.col(c).cast("string"))
    rules = {note: (F.col(c) > 0, figure(c)) for note, c in dirty.items()}
    rules["no_records"] = (F.col("records") == 0, figure("records"))
    rules["all_clear"] = ((F.col("records") > 0) & (F.col("error_records") == 0) & (F.col("duplicate_entity_ids") == 0),
                          figure("records"))
    notes = F.array(*[F.when(rules[k][0], F.struct(F.lit(i).alias("rule"), F.lit(k).alias("note"), rules[k][1].alias("text")))
                      for i, k in enumerate(NOTE_RULES, start=1)])
    return summary.select(F.explode(F.filter(notes, lambda x: x.isNotNull())).alias("n")).select("n.*")


def records_per_group(df: DataFrame, *keys: str) -> DataFrame:
    """AGG-10: rows produced per key combination, e.g. (city, month)."""
    return df.groupBy(*[qcol(k) for k in keys]).agg(F.count(F.lit(1)).alias("records"))


def latest_month(df: DataFrame, key: str, month: str, requested: str = "latest",
                 as_of: str | None = None) -> DataFrame:
    """AGG-11: month per key: max available 'YYYYMM'; an explicit month is
    validated and taken as is; none available -> the month of ``as_of``."""
    keys = qcol(key)
    if requested.strip().lower() != "latest":
        if not re.fullmatch("[0-9]{6}", requested.strip()):
            raise ValueError(f"not a month (YYYYMM) nor 'latest': {requested!r}")
        return df.select(keys, F.lit(requested.strip()).alias("month")).distinct()
    now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    months = F.max(F.when(qcol(month).rlike("^[0-9]{6}$"), qcol(month)))
    return df.groupBy(keys).agg(F.coalesce(months, F.date_format(now, "yyyyMM")).alias("month"))


def region_variants(df: DataFrame, col: str) -> DataFrame:
    """AGG-12: normalised names (lower, trimmed, inner blanks removed) with
    more than one raw spelling: one row per (normalized, variant) plus the
    spelling count. Relational, so no group is gathered into one list."""
    raw = qcol(col)
    norm = F.regexp_replace(F.lower(F.trim(raw)), r"(?U)\s+", "")
    pairs = (df.select(norm.alias("normalized"), raw.alias("variant"))
             .filter(F.col("variant").isNotNull()).distinct())
    counts = pairs.groupBy("normalized").agg(F.count(F.lit(1)).alias("spellings")).filter("spellings > 1")
    return pairs.join(counts, "normalized", "inner")


def wave_coverage(df: DataFrame, entity: str, ts: str, grain: str = "day",
                  approximate: bool = False) -> DataFrame:
    """AGG-13: distinct entities and rows per wave."""
    w = F.date_trunc(grain, qcol(ts)).alias("wave")
    ent = F.approx_count_distinct(qcol(entity)) if approximate else F.count_distinct(qcol(entity))
    return df.groupBy(w).agg(ent.alias("entities"), F.count(F.lit(1)).alias("rows"))


def row_unit_check(df: DataFrame, key: str, text: str, page: str,
                   max_median_chars: int = 2000) -> DataFrame:
    """AGG-14: is a row an observation (not a page dump)? Key uniqueness,
    exact median text length (a count per distinct length), rows per source page."""
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(qcol(key)).alias("distinct_keys"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY length(`{text}`))").cast("int").alias("median_chars"),
        F.count_distinct(qcol(page)).alias("pages"),
    )
    return stats.select(
        "rows", "distinct_keys", "median_chars",
        (F.col("rows") / F.greatest(F.col("pages"), F.lit(1))).alias("rows_per_page"),
        ((F.col("rows") == F.col("distinct_keys")) & (F.col("median_chars") <= max_median_chars)).alias("is_observation"),
    )


def provenance_completeness(df: DataFrame, required: list[str]) -> DataFrame:
    """AGG-15: share of rows carrying every required provenance column."""
    present = [c for c in required if c in df.columns]
    if len(present) < len(required):
        complete = F.lit(False)
    else:
        complete = F.lit(True)
        for c in present:
            complete = complete & ~is_missing(df, c)
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(complete).alias("complete_rows"),
                  F.coalesce(F.avg(complete.cast("double")), F.lit(0.0)).alias("share"))
