"""EXT-4 link discovery, FLT-1 allow/deny filtering, LIM-1 cap per listing.

All work for one listing happens inside its own row with array functions:
extract hrefs in document order, resolve, de-duplicate keeping the first
occurrence (``array_distinct`` preserves first-seen order), cap, then
filter. No shuffle is needed however many listings there are, and a hot
host costs no more than its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions._util import col_of
from strata.functions.text import unescape
from strata.functions.urls import base_struct, resolve_array
from strata.session import materialize

# Anchors' href attribute values (the default selector ``a::attr(href)``),
# in either quote or bare; case-insensitive.
HREF_PATTERN = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
COMMENT_PATTERN = r"(?s)<!--.*?-->"


def href_values(html) -> Column:
    """Raw href values of all anchors outside comments, in document order."""
    page = col_of(html)
    shown = F.when(page.contains("<!--"), F.regexp_replace(page, COMMENT_PATTERN, "")).otherwise(page)
    return F.transform(F.regexp_extract_all(shown, F.lit(HREF_PATTERN), 1), lambda h: F.when(
        h.rlike("^[\"']"), F.substring(h, F.lit(2), F.length(h) - 2)).otherwise(h))


def clean_hrefs(html) -> Column:
    """Anchors' href values: entity-decoded, tab/line breaks removed,
    trimmed, blanks dropped; document order kept."""
    raw = F.transform(href_values(html), lambda h: F.trim(F.regexp_replace(unescape(h), r"[\t\r\n]", "")))
    return F.filter(raw, lambda h: h != "")


def link_array(refs, base, max_links: int | None = None,
               allow: str | None = None, deny: str | None = None) -> Column:
    """Per-row ``array<string>``: resolved, first-seen, capped, then filtered.

    ``refs`` is a ``clean_hrefs`` column and ``base`` a ``base_struct``
    column, each materialised in an earlier projection (see
    ``with_link_inputs``) so neither is recomputed per use.
    The cap is applied before allow/deny, so fewer than ``max_links`` may
    remain. ``max_links=None`` means no cap; ``0`` means no links.
    """
    links = F.array_distinct(resolve_array(col_of(base), col_of(refs)))
    if max_links is not None:
        links = F.slice(links, 1, max_links) if max_links > 0 else F.array().cast("array<string>")
    return filter_link_array(links, allow, deny)


def with_link_inputs(pages: DataFrame, html: str = "html", base: str = "url",
                     keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Project ``keep`` plus the parsed base (``__bp``) and cleaned hrefs
    (``__refs``); the html column is dropped here, before anything else."""
    return pages.select(*keep, base_struct(base).alias("__bp"), clean_hrefs(html).alias("__refs"))


def filter_link_array(links: Column, allow: str | None, deny: str | None) -> Column:
    if allow:
        links = F.filter(links, lambda u: u.rlike(allow))
    if deny:
        links = F.filter(links, lambda u: ~u.rlike(deny))
    return links


def discover_links(pages: DataFrame, html: str = "html", base: str = "url",
                   keys: tuple[str, ...] = ("page_id",), max_links: int | None = None,
                   allow: str | None = None, deny: str | None = None) -> DataFrame:
    """EXT-4 (+ LIM-1, FLT-1): one row per kept link: ``keys..., pos, link``.

    ``pos`` is the 1-based position among the kept links of the listing.
    """
    staged = with_link_inputs(pages, html, base, keys)
    arr = link_array("__refs", "__bp", max_links, allow, deny)
    return (staged.select(*keys, F.posexplode(arr).alias("pos0", "link"))
            .select(*keys, (F.col("pos0") + 1).cast("long").alias("pos"), "link"))


def discover_links_selector(pages: DataFrame, selector: str = "a::attr(href)", key: str = "page_id",
                            html: str = "html", base: str = "url", max_links: int | None = None,
                            allow: str | None = None, deny: str | None = None) -> DataFrame:
    """EXT-4 with a link selector: as ``discover_links``, for the values of
    ``selector`` (an ``::attr(x)`` or ``::text`` one) on the parsed page, by
    a unique ``key``. Only matched values are shuffled, one list a page. An
    unsupported selector raises."""
    from strata.operators import html as H
    H.parse_selector(selector)
    nodes = materialize(H.shred_elements(pages, key, html, H.selector_attrs(selector)), "nodes")
    values = H.select_fields(nodes, {"link": selector}).filter(F.col("pos").isNotNull())
    ref = F.trim(F.regexp_replace("value", r"[\t\r\n]", ""))
    refs = (values.select("page_id", "pos", ref.alias("ref")).filter("ref != ''").groupBy("page_id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("__refs")))
    bases = pages.select(col_of(key).alias("page_id"), base_struct(base).alias("__bp"))
    arr = link_array("__refs", "__bp", max_links, allow, deny)
    return (bases.join(refs, "page_id").select("page_id", F.posexplode(arr).alias("pos0", "link"))
            .select(F.col("page_id").alias(key), (F.col("pos0") + 1).cast("long").alias("pos"), "link"))


def filter_links(df: DataFrame, allow: str | None = None, deny: str | None = None,
                 col: str = "link") -> DataFrame:
    """FLT-1 on a link table: regex search semantics, allow then deny."""
    out = df
    if allow:
        out = out.filter(F.col(col).rlike(allow))
    if deny:
        out = out.filter(~F.col(col).rlike(deny))
    return out
