"""Portal pages to store: cards are read, filtered, tagged, resolved and merged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import with_challenge
from postloom.operators.listings import (
    drop_seen,
    dry_stop,
    normalise_cards,
    progress_key,
    stall_stop,
)
from postloom.operators.merge import merge_with_keys
from postloom.operators.ordered import shuffled, small
from postloom.operators.profiles import profile_totals, tag_listings
from postloom.operators.progress import progress_rollup, seen_rollup
from postloom.operators.resolve import (
    assemble_resolved,
    attach_details,
    follow_redirects,
    match_company,
    with_final_ats,
)
from postloom.session import cut
from postloom.sources.extract import extract_fallback, read_cards
from postloom.sources.payloads import position_seq, take_first


@dataclass(frozen=True)
class DiscoverResult:
    store: DataFrame
    keys: DataFrame
    listings: DataFrame
    batch: DataFrame
    resolve_errors: DataFrame
    progress: DataFrame
    seen: DataFrame
    totals: DataFrame
    summary: DataFrame
    errors: DataFrame


def read_result_pages(
    raw_pages: DataFrame,
    frontier: DataFrame,
    seen: DataFrame,
    now: str,
    *,
    selectors: dict | None = None,
    max_pages: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(listings, pages)``: new listings, and what a crawl would have recorded.

    ``pages`` has a row for each page read, ``failed`` and ``reason`` set for the page on which
    its key's crawl broke off (a challenge), and a row without a page number for each key whose
    captured pages held no result at all. A failed page and those after it are not read, so the
    cursor of the key stays before it.
    """
    keyed = raw_pages.withColumn(
        "key", progress_key(F.col("source"), F.col("keyword"), F.col("location"))
    )
    # Roles may share a keyword; its pages belong to the first of them.
    items = frontier.groupBy("key").agg(
        F.min("start_page").alias("start_page"),
        F.min_by("profile", F.struct("role_seq", "pos")).alias("role_profile"),
    )
    items = cut(items, "frontier")
    keyed = keyed.join(small(items), "key").where(F.col("page_no") >= F.col("start_page"))
    marked = with_challenge(keyed.withColumn("title", F.lit(None).cast("string")), "title", "html").drop("title")
    # Markup is read, searched for signs of a challenge and left behind in one go.
    whole = cut(read_cards(marked, selectors), "cards")
    pages = whole.select(
        "key", "source", "keyword", "location", "page_no", "start_page",
        F.col("challenge").isNotNull().alias("failed"), F.col("challenge").alias("reason"),
        F.size("cards").cast("long").alias("n_cards"),
    )
    cards = whole.select(*[c for c in whole.columns if c not in ("challenge", "cards")], F.inline("cards"))
    cards = cards.withColumn("seq", position_seq(F.col("seq"), F.col("pos")))
    listings = normalise_cards(cards, now)
    ids = cut(listings.select("key", "source", "page_no", "sourceJobId"), "card-ids")
    google = F.col("source") == "google-jobs"
    paged = dry_stop(pages.where(~google), ids.where(~google), ["key"], seen=seen, max_pages=max_pages)
    endless = stall_stop(pages.where(google), ids.where(google), ["key"], seen=seen, max_pages=max_pages)
    stops = paged.unionByName(endless)
    # One row for each search: where it ends, on which page it broke off, and whether it had no result at all. A failed page
    # counts only if the crawl would have come as far as that.
    page, at = F.col("page_no"), F.col("broken_at")
    inside = page <= F.col("last_page")
    searches = pages.join(shuffled(stops), "key", "left").groupBy("key").agg(
        F.first("last_page").alias("last_page"),
        F.min(F.when(inside & F.col("failed"), page)).alias("broken_at"),
        F.count_if(inside & (F.col("failed") | (F.col("n_cards") > 0))).alias("results"),
        F.min_by(F.struct("source", "keyword", "location", "start_page"), "page_no").alias("who"),
    )
    searches = cut(searches, "searches")

    def up_to_break(df: DataFrame, last: bool) -> DataFrame:
        ends = searches.where("results > 0").select("key", "last_page", "broken_at")
        before = at.isNull() | (page < at) | (page == at if last else F.lit(False))
        return df.join(shuffled(ends), "key").where(inside & before).drop("last_page", "broken_at")

    read = up_to_break(pages.where(F.col("failed") | (F.col("n_cards") > 0)), last=True)
    kept = up_to_break(listings, last=False)
    # Searches without any result have still been carried out.
    silent = searches.where("results = 0").select("key", "who.*").withColumn("failed", F.lit(False))
    read = read.unionByName(silent, allowMissingColumns=True)
    return drop_seen(kept, seen, ["key"], "sourceJobId", ["page_no", "pos"]), read


def resolve(
    listings: DataFrame,
    redirects: DataFrame,
    registry: DataFrame,
    detail_payloads: DataFrame,
    detail_pages: DataFrame,
    now: str,
    **match_options,
) -> tuple[DataFrame, DataFrame]:
    """Listings to postings, and the listings that could not be resolved."""
    where = follow_redirects(listings, redirects)
    known = with_final_ats(match_company(where, registry, **match_options))
    full = attach_details(known, detail_payloads, extract_fallback(detail_pages))
    return assemble_resolved(full, now)


def discover(
    raw_pages: DataFrame,
    frontier: DataFrame,
    roles: DataFrame,
    registry: DataFrame,
    redirects: DataFrame,
    detail_payloads: DataFrame,
    detail_pages: DataFrame,
    progress: DataFrame,
    seen: DataFrame,
    store: DataFrame | None,
    now: str,
    *,
    selectors: dict | None = None,
    career_listings: DataFrame | None = None,
    limit: int | None = None,
    max_pages: int | None = None,
    sources: DataFrame | None = None,
    store_keys: DataFrame | None = None,
    per_keyword: bool = False,
    **match_options,
) -> DiscoverResult:
    """One run over landed result pages.

    ``career_listings`` adds listings of registry companies, as
    :func:`postloom.plans.companies.company_listings` makes them, already filtered against ``seen``. ``sources`` is the full list of
    targets, so that a resumed run counts those that were finished before; by default the
    sources still in the frontier. ``errors`` is one row per search that broke off.
    """
    found, read = read_result_pages(
        raw_pages, frontier, seen, now, selectors=selectors, max_pages=max_pages
    )
    if career_listings is not None:
        found = found.unionByName(career_listings, allowMissingColumns=True)
    listings = cut(tag_listings(found, roles, per_keyword=per_keyword), "listings")
    chosen = take_first(listings, limit)
    batch, failed = resolve(
        chosen, redirects, registry, detail_payloads, detail_pages, now, **match_options
    )
    batch = cut(batch, "resolved")
    after, keys = merge_with_keys(store, batch, now, store_keys=store_keys)
    after = cut(after, "merged")

    flagged = with_challenge(
        raw_pages.withColumn("title", F.lit(None).cast("string")), "title", "html"
    ).where(F.col("challenge").isNotNull())
    read = cut(read, "read-pages")
    new_progress = progress_rollup(read, progress, now)
    errors = read.where("failed").select(
        "source", "keyword", "location", "page_no",
        F.concat_ws("::", "source", "keyword").alias("search"), F.col("reason").alias("message"),
    )
    attempted = frontier.select("source").distinct() if sources is None else sources.select("source").distinct()
    broken = errors.select("source").distinct()
    # Jobs of companies are remembered with the company's name: ids of two boards may be equal.
    named = F.coalesce("seen_id", "sourceJobId") if "seen_id" in listings.columns else F.col("sourceJobId")
    new_seen = seen_rollup(listings.withColumn("known_as", named), seen, "known_as")
    before = batch.limit(0) if store is None else store

    def n(df: DataFrame):
        return df.agg(F.count(F.lit(1))).scalar()

    summary = batch.sparkSession.range(1).select(
        n(attempted).alias("sourcesAttempted"),
        (n(attempted) - n(broken)).alias("sourcesSucceeded"),
        n(broken).alias("sourcesFailed"),
        n(listings).alias("listingsDiscovered"),
        n(batch).alias("jdsExtracted"),
        (n(before) + n(batch) - n(after)).alias("duplicatesRemoved"),
        n(after).alias("jobsWritten"),
        n(flagged).alias("challenges"),
    )
    return DiscoverResult(
        after, keys, listings, batch, failed, new_progress, new_seen, profile_totals(batch), summary, errors
    )
