"""Captured pages of generic career sites to jobs with details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.listings import collapse_links, link_stop, up_to_last_page
from postloom.operators.ordered import small
from postloom.session import cut
from postloom.sources.extract import extract_details, extract_site_links, selector_fault
from postloom.sources.payloads import position_seq

USED_SELECTORS = ["jobLinkSelector", "titleSelector", "locationSelector", "descriptionSelector"]


def selector_errors(sites: DataFrame) -> DataFrame:
    """``(site_id, site_seq, fail_seq, list_failed, message)`` of generic sites that have a selector
    which cannot be used. Missing ones are configuration errors and reported as such."""
    generic = sites.where((F.col("adapter") == "generic") & F.col("generic").isNotNull())
    faults = F.coalesce(*[selector_fault(F.col(f"generic.{s}")) for s in USED_SELECTORS])
    told = F.concat(F.lit('Site "'), F.col("id"), F.lit('" has a selector that cannot be used: '), faults)
    return generic.select(
        F.col("id").alias("site_id"),
        F.col("seq").alias("site_seq"),
        F.lit(None).cast("long").alias("fail_seq"),
        F.lit(True).alias("list_failed"),
        told.alias("message"),
    ).where(F.col("message").isNotNull())


def generic_jobs(
    pages: DataFrame,
    detail_pages: DataFrame,
    sites: DataFrame,
    searches: DataFrame,
    max_pages: int | None = None,
    max_jobs: int | None = None,
) -> DataFrame:
    """``(site_id, seq, url, matchedProfiles, detail)`` for ``collect``.

    ``pages`` has ``seq, site_id, keyword, page_no, url, html``; a page belongs to the search of
    its keyword, and to the unfiltered search if there are no searches. A search ends at the first
    page without a control that leads on, or after one that adds no link. A link found by
    several searches is one job with the profiles of all. ``detail_pages`` has ``url, html``;
    a job whose page was not captured yields nothing.
    """
    config = sites.where((F.col("adapter") == "generic") & F.col("enabled")).select(
        F.col("id").alias("site_id"),
        *[F.col(f"generic.{s}").alias(s) for s in (*USED_SELECTORS, "applyLinkSelector")],
        F.coalesce("generic.loadMoreSelector", "generic.nextButtonSelector").alias("advanceSelector"),
    )
    none = F.array().cast("array<string>")
    if searches.isEmpty():
        tagged = pages.withColumns({"search_no": F.lit(-1).cast("long"), "matchedProfiles": none})
    else:
        wanted = searches.select("search_no", F.lower("keyword").alias("keyword"), F.col("profileIds").alias("matchedProfiles"))
        tagged = pages.withColumn("keyword", F.lower("keyword")).join(small(wanted), "keyword")
    ready = tagged.join(small(config.select("site_id", "jobLinkSelector", "advanceSelector")), "site_id")
    read = cut(extract_site_links(ready), "site-links")
    keys = ["site_id", "search_no"]
    visited = read.where("pos < 0").select(*keys, "page_no", "has_next")
    links = read.where("pos >= 0").select(
        *keys, "page_no", "url", "matchedProfiles", position_seq(F.col("seq"), F.col("pos")).alias("seq")
    )
    stops = link_stop(visited, links, keys, max_pages)
    jobs = collapse_links(up_to_last_page(links, stops, keys), ["search_no"], max_jobs)
    captured = detail_pages.groupBy("url").agg(F.max("html").alias("html"))
    full = jobs.join(captured, "url").join(
        small(config.drop("jobLinkSelector", "advanceSelector")), "site_id"
    )
    details = extract_details(full.withColumn("listing_title", F.lit("")))
    return details.select("site_id", "seq", "url", "matchedProfiles", "detail")
