"""Record-level expressions: hashes, archive stems, ids, headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions._util import col_of

# Header names whose values are redacted before archiving.
SENSITIVE_HEADERS = ["cookie", "set-cookie", "authorization", "proxy-authorization"]
REDACTED = "[redacted]"


def content_hash(body) -> Column:
    """FN-1: sha256 hex of the raw bytes (strings are hashed as UTF-8 bytes)."""
    return F.sha2(col_of(body), 256)


def archive_stem(fetched_at, chash) -> Column:
    """FN-9: '<ISO timestamp without colons, + as Z>_<first 16 hash chars>'.

    For a UTC timestamp the ISO form ends in '+00:00', hence 'Z0000'.
    """
    return F.concat(F.date_format(col_of(fetched_at), "yyyy-MM-dd'T'HHmmss'Z0000'"),
                    F.lit("_"), F.substring(col_of(chash), 1, 16))


def entity_id(source: str, *parts) -> Column:
    """FN-8: 'source:part1:part2...'."""
    return F.concat_ws(":", F.lit(source), *[col_of(p) if not isinstance(p, (int, float)) else F.lit(p) for p in parts])


def header_value(headers, name: str) -> Column:
    """Value of the first header whose name matches case-insensitively."""
    hit = F.map_filter(col_of(headers), lambda k, v: F.lower(k) == name.lower())
    return F.try_element_at(F.map_values(hit), F.lit(1))


def guess_extension(headers) -> Column:
    """FN-3: file extension from content-type: json, xml, text/plain, else html."""
    ct = F.lower(F.coalesce(header_value(headers, "content-type"), F.lit("")))
    return (F.when(ct.contains("json"), ".json").when(ct.contains("xml"), ".xml")
            .when(ct.contains("text/plain"), ".txt").otherwise(".html"))


def redact_headers(headers) -> Column:
    """PRJ-7: sensitive header values (case-insensitive name) -> '[redacted]'."""
    return F.transform_values(
        col_of(headers),
        lambda k, v: F.when(F.lower(k).isin(SENSITIVE_HEADERS), F.lit(REDACTED)).otherwise(v))


def archive_row_id(columns: list[str], body: str = "body") -> Column:
    """SHA-256 of a row's metadata (URL, fetch time, path and all other
    ``columns``) and of its body: never null, and equal for equal rows alone,
    so that extractions can be keyed by it where paths are missing or shared.
    A null value and a missing body differ from empty ones."""
    meta = F.to_json(F.struct(*[col_of(f"`{c}`") for c in columns if c != body]), {"ignoreNullFields": "false"})
    own = F.coalesce(F.sha2(F.col(f"`{body}`"), 256), F.lit("no body")) if body in columns else F.lit("")
    return F.sha2(F.concat(meta, F.lit("\n"), own), 256)
