"""Listing -> detail flow (survey 3.2) as one lazy plan over many listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.urls import url_host
from strata.operators.links import discover_links


def links_per_host(pages: DataFrame, max_links: int | None = None,
                   allow: str | None = None, deny: str | None = None) -> DataFrame:
    """Minimum slice: pages -> links (resolve, first-seen, cap, filter) ->
    kept links and listing pages per link host.

    Links are produced inside each page row; the only shuffle is the final
    aggregation, which is partial (map-side) first, so a hot host sends one
    partial row per task, not its links.
    """
    links = discover_links(pages.select("page_id", "url", "html"), max_links=max_links,
                           allow=allow, deny=deny)
    return (links.groupBy(url_host("link").alias("host"))
            .agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("page_id").alias("n_pages")))
