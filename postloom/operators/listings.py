"""Result cards to listings, seen-id filtering and the rules that end a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import falsy_or
from postloom.functions.urls import encode_component, url_path
from postloom.operators.ordered import first_n_in_key, lag_in_key, shuffled
from postloom.schemas import LISTING
from postloom.sources.payloads import cap_pages, collapse_first_seen


def progress_key(source: Column, keyword: Column, location: Column) -> Column:
    return F.concat_ws("::", F.lower(source), F.lower(keyword), F.lower(location))


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def card_job_id(source: Column) -> Column:
    """The portal's own identifier of a card."""
    href = F.col("href")
    last_piece = falsy_or(F.element_at(F.split(url_path(href), "/"), -1), href)
    urn = F.nullif(F.element_at(F.split("entity_urn", ":"), -1), F.lit(""))
    return (
        F.when(source == "indeed", _found(href, r"[?&]jk=([^&]+)"))
        .when(
            source == "linkedin-public",
            F.coalesce(urn, _found(href, r"view/(\d+)"), _found(href, r"view/([a-zA-Z0-9-]+)"), href),
        )
        .when(
            source == "google-jobs",
            falsy_or(F.col("data_job_id"), F.col("element_id"), F.concat_ws("::", "title", "company")),
        )
        .otherwise(last_piece)
    )


def normalise_cards(cards: DataFrame, now: str) -> DataFrame:
    """Cards of any portal to listings. Cards without a title, or without a link where the
    portal has links, are dropped.

    ``cards`` carries ``source, keyword, title, href, company, location_text, salary, age,
    data_job_id, entity_urn, element_id``; other columns (page, position, key) are kept.
    """
    google = F.col("source") == "google-jobs"
    usable = (F.col("title") != "") & (google | (F.coalesce(F.col("href"), F.lit("")) != ""))
    rows = cards.where(usable).withColumn("sourceJobId", card_job_id(F.col("source")))
    google_url = F.concat(
        F.lit("https://www.google.com/search?q="),
        encode_component(F.concat_ws(" ", "title", "company")),
        F.lit("&ibp=htl;jobs#fpstate=tldetail&htidocid="),
        encode_component(F.col("sourceJobId")),
    )
    listing = {
        "source": F.col("source"),
        "searchKeyword": F.col("keyword"),
        "title": F.col("title"),
        "company": F.col("company"),
        "location": F.col("location_text"),
        "salarySnippet": F.col("salary"),
        "resultUrl": F.when(google, google_url).otherwise(F.col("href")),
        "possibleOfficialUrl": F.lit(None).cast("string"),
        "postingAgeOrDate": F.col("age"),
        "sourceJobId": F.col("sourceJobId"),
        "discoveredAt": F.lit(now),
        "matchedProfiles": F.array().cast("array<string>"),
    }
    used = {
        "source", "keyword", "title", "href", "company", "location_text", "salary", "age",
        "data_job_id", "entity_urn", "element_id", "sourceJobId", "location",
    }
    kept = [c for c in rows.columns if c not in used]
    return rows.select(*kept, *[listing[c].alias(c) for c in LISTING.fieldNames()])


def company_career_listings(jobs: DataFrame, keyword: str, now: str) -> DataFrame:
    """Jobs of a registry company to listings. ``jobs`` carries ``company`` and ``detail``."""
    listing = {
        "source": F.lit("company-careers"),
        "searchKeyword": F.lit(keyword),
        "title": F.col("title"),
        "company": F.col("company"),
        "location": F.coalesce(F.col("detail.location"), F.lit("")),
        "salarySnippet": F.col("detail.salaryText"),
        "resultUrl": F.col("url"),
        "possibleOfficialUrl": F.col("url"),
        "postingAgeOrDate": F.lit(None).cast("string"),
        "sourceJobId": F.col("externalId"),
        "discoveredAt": F.lit(now),
        "matchedProfiles": F.col("matchedProfiles"),
    }
    return jobs.select(
        "seq",
        F.when(
            F.col("externalId") != "", F.concat_ws("::", F.lower("company"), "externalId")
        ).alias("seen_id"),
        *[listing[c].alias(c) for c in LISTING.fieldNames()],
    )


def _has_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col), F.lit("")) != ""


def first_seen(
    df: DataFrame, keys: list[str], id_col: str, order_cols: list[str]
) -> DataFrame:
    """First row per (keys, id); rows without an id are all kept.

    An aggregate instead of a ranking, so repeats are dropped before the shuffle.
    """
    rest = [c for c in df.columns if c not in (*keys, id_col)]
    firsts = (
        df.where(_has_id(id_col))
        .groupBy(*keys, id_col)
        .agg(F.min_by(F.struct(*rest), F.struct(*order_cols)).alias("row"))
        .select(*keys, id_col, "row.*")
    )
    return firsts.select(*df.columns).unionByName(df.where(~_has_id(id_col)))


def drop_seen(
    df: DataFrame, seen: DataFrame, keys: list[str], id_col: str, order_cols: list[str]
) -> DataFrame:
    """Rows whose id was not seen before under the same key, first occurrence only.

    ``seen`` has the key columns and ``source_job_id``.
    """
    old = seen.select(*keys, F.col("source_job_id").alias(id_col))
    fresh = first_seen(df.where(_has_id(id_col)), keys, id_col, order_cols)
    fresh = fresh.join(shuffled(old), [*keys, id_col], "left_anti").select(*df.columns)
    return fresh.unionByName(df.where(~_has_id(id_col)))


def first_pages(cards: DataFrame, seen: DataFrame | None, keys: list[str], id_col: str) -> DataFrame:
    """``(keys, id_col, page_no)``: the page on which an id that was not seen before appears for the first time."""
    first = cards.where(_has_id(id_col)).groupBy(*keys, id_col).agg(F.min("page_no").alias("page_no"))
    if seen is not None:
        old = seen.select(*keys, F.col("source_job_id").alias(id_col))
        first = first.join(shuffled(old), [*keys, id_col], "left_anti")
    return first


def new_ids_per_page(
    cards: DataFrame, seen: DataFrame | None, keys: list[str], id_col: str
) -> DataFrame:
    """``(keys, page_no, new_ids)``: ids that appear for the first time on a page."""
    first = first_pages(cards, seen, keys, id_col)
    return first.groupBy(*keys, "page_no").agg(F.count(F.lit(1)).alias("new_ids"))


def _with_new_ids(pages: DataFrame, new_ids: DataFrame, keys: list[str]) -> DataFrame:
    joined = pages.join(shuffled(new_ids), [*keys, "page_no"], "left")
    return joined.withColumn("new_ids", F.coalesce("new_ids", F.lit(0)))


def _last_page(pages: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """``(keys, last_page)``: the page ahead of the first ``before``, or the first ``after``."""
    page = F.col("page_no")
    return (
        pages.groupBy(*keys)
        .agg(
            F.least(
                F.min(F.when(before, page - 1)), F.min(F.when(after, page)), F.max(page)
            ).alias("last_page")
        )
    )


def _failed(pages: DataFrame) -> Column:
    return F.coalesce("failed", F.lit(False)) if "failed" in pages.columns else F.lit(False)


def page_verdicts(
    pages: DataFrame, cards: DataFrame, keys: list[str], id_col: str, seen: DataFrame | None = None,
    endless: Column | None = None,
) -> DataFrame:
    """``pages`` with ``before`` and ``after``: whether the stop rules end the crawl ahead of a page, or with it.

    The rules are those of :func:`dry_stop`, and of :func:`stall_stop` where ``endless`` holds. ``n_before``, if there is
    such a column, is the number of cards of the page ahead of the first one here.
    """
    counted = _with_new_ids(pages, new_ids_per_page(cards, seen, keys, id_col), keys)
    lagged = lag_in_key(counted, keys, "page_no", "n_cards", "__lag")
    shown = F.coalesce("__lag", "n_before") if "n_before" in pages.columns else F.col("__lag")
    failed = _failed(pages)
    stall = F.lit(False) if endless is None else F.coalesce(endless, F.lit(False))
    same = F.coalesce(F.col("n_cards") == shown, F.lit(False))
    dry = (F.col("new_ids") == 0) & (stall | (F.col("page_no") > F.col("start_page")))
    return lagged.select(
        *keys, "page_no", "n_cards",
        failed.alias("failed"),
        (~failed & ((F.col("n_cards") == 0) | (stall & same))).alias("before"),
        (~failed & dry).alias("after"),
    )


def dry_stop(
    pages: DataFrame, cards: DataFrame, keys: list[str], id_col: str = "sourceJobId",
    seen: DataFrame | None = None, max_pages: int | None = None,
) -> DataFrame:
    """``(keys, last_page)`` of a paged portal.

    ``pages`` has ``(keys, page_no, start_page, n_cards)``. A page without cards ends the crawl
    and is not recorded; a page after the start page without a new id is the last one recorded.
    A page marked ``failed`` (optional column) was not read, so it is neither empty nor dry.
    """
    if max_pages is not None:
        pages, cards = cap_pages(pages, max_pages), cap_pages(cards, max_pages)
    read = ~_failed(pages)
    judged = pages.select(
        *keys, "page_no",
        F.lit(1).alias("pages"),
        (read & (F.col("n_cards") == 0)).alias("empty"),
        (read & (F.col("page_no") > F.col("start_page"))).alias("later"),
    )
    # Pages and the ids that are new on them are counted together, which needs no sorting.
    new_ids = first_pages(cards, seen, keys, id_col).select(*keys, "page_no", F.lit(1).alias("new_ids"))
    counted = judged.unionByName(new_ids, allowMissingColumns=True).groupBy(*keys, "page_no").agg(
        F.count("pages").alias("pages"), F.count("new_ids").alias("new_ids"),
        F.max("empty").alias("empty"), F.max("later").alias("later"),
    )
    dry = (F.col("new_ids") == 0) & F.col("later")
    return _last_page(counted.where("pages > 0"), keys, F.col("empty"), dry)


def stall_stop(
    pages: DataFrame, cards: DataFrame, keys: list[str], id_col: str = "sourceJobId",
    seen: DataFrame | None = None, max_pages: int | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """``(keys, last_page)`` of an endless list: also ends before a capture that shows as many
    cards as the one before, and after any capture without a new id."""
    if max_pages is not None:
        pages, cards = cap_pages(pages, max_pages), cap_pages(cards, max_pages)
    counted = _with_new_ids(pages, new_ids_per_page(cards, seen, keys, id_col), keys)
    if blocks is None and max_pages is not None:
        blocks = 1  # the page cap bounds every key
    lagged = lag_in_key(counted, keys, "page_no", "n_cards", "before", blocks)
    stalled = (F.col("n_cards") == 0) | F.coalesce(F.col("n_cards") == F.col("before"), F.lit(False))
    read = ~_failed(pages)
    return _last_page(lagged, keys, read & stalled, read & (F.col("new_ids") == 0))


def link_stop(
    pages: DataFrame, links: DataFrame, keys: list[str], max_pages: int | None = None
) -> DataFrame:
    """``(keys, last_page)`` of a career site: the first page without an advance control, or the
    first one after page 1 that adds no link. ``pages`` has ``(keys, page_no, has_next)``."""
    if max_pages is not None:
        pages, links = cap_pages(pages, max_pages), cap_pages(links, max_pages)
    counted = _with_new_ids(pages, new_ids_per_page(links, None, keys, "url"), keys)
    dry = (F.col("new_ids") == 0) & (F.col("page_no") > 1)
    return _last_page(counted, keys, F.lit(False), ~F.col("has_next") | dry)


def up_to_last_page(df: DataFrame, stops: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(shuffled(stops), keys).where(F.col("page_no") <= F.col("last_page")).drop("last_page")


def collapse_links(
    links: DataFrame, search_keys: list[str], max_jobs: int | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Links of a career site to one row per URL with the profiles of every search that found it.

    ``links`` has ``site_id, url, seq, matchedProfiles`` and the search key columns. Each search,
    and then each site, keeps its first ``max_jobs`` distinct links; all of them without a cap.
    """
    per_search = collapse_first_seen(
        links, ["site_id", *search_keys, "url"], "seq", "matchedProfiles", []
    )
    if max_jobs is None:
        return collapse_first_seen(links, ["site_id", "url"], "seq", "matchedProfiles", [])
    capped = first_n_in_key(per_search, ["site_id", *search_keys], "seq", max_jobs, blocks)
    per_site = collapse_first_seen(capped, ["site_id", "url"], "seq", "matchedProfiles", [])
    return first_n_in_key(per_site, ["site_id"], "seq", max_jobs, blocks)
