"""Captured pages to rows. Pages are spread over the cluster by Spark; each is read once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from postloom.functions.text import WS_CHARS, clean_text, falsy_or
from postloom.operators.ordered import spread
from postloom.operators.resolve import detail_struct, page_detail
from postloom.schemas import FLAG, INT, shape
from postloom.sources.html import Element, compiled, first, first_of, parse, select, selector_error, trimmed

# Where each portal keeps the parts of a result card.
PORTAL_SELECTORS = {
    "indeed": {
        "card": ".job_seen_beacon",
        "title": "span[id^='jobTitle']",
        "link": "a.jcs-JobTitle",
        "company": "[data-testid='company-name']",
        "location": "[data-testid='text-location']",
        "salary": ".salary-snippet-container, .estimated-salary-container",
        "age": "span.date",
    },
    "linkedin-public": {
        "card": ".job-search-card, .base-search-card, li[data-id]",
        "title": ".base-search-card__title, h3",
        "link": "a.base-card__full-link, a",
        "company": ".base-search-card__subtitle, h4, [class*='subtitle']",
        "location": ".job-search-card__location, span[class*='location']",
        "salary": ".job-search-card__salary-info",
        "age": "time, .job-search-card__listdate",
    },
    "monster": {
        "card": "article, [data-testid='job-card'], [class*='JobCard']",
        "title": "[data-testid='job-title'], [class*='Title'], h2",
        "link": "a",
        "company": "[data-testid='job-company'], [class*='Company']",
        "location": "[data-testid='job-location'], [class*='Location']",
        "salary": "[data-testid='job-salary'], [class*='Salary']",
        "age": "[data-testid='job-date'], [class*='Date']",
    },
    "google-jobs": {
        "card": "li[data-job-id], [role='treeitem'], .i3PoEe, [class*='JobCard']",
        "title": "[role='heading'], [class*='Title'], h2, h3",
        "company": ".t7YFBb, .wTabPo, [class*='Company'], [class*='company']",
        "location": ".SuWscb, .Qk3OTc, [class*='Location'], [class*='location']",
        "salary": "[class*='Salary'], [class*='salary']",
        "age": "[class*='Date'], [class*='date'], span:has-text('ago')",
    },
}

# Places to look for a description on an unknown page, and the least length.
FALLBACK_SELECTORS = [
    ".job-description",
    ".description",
    "#job-description",
    "[class*='description']",
    "article",
    "main",
    ".content",
]
FALLBACK_MIN_CHARS = 200

# Characters a browser leaves alone when it writes out a link.
URL_SAFE = "!#$%&'()*+,-./:;=?@[\\]^_{|}~"


def site_card_selectors(sites: DataFrame) -> dict[str, dict[str, str]]:
    """Card selectors of the generic sites (configuration, one entry per site)."""
    rows = sites.where(F.col("generic").isNotNull()).select("id", "name", "generic.*").collect()
    return {
        r["id"]: {
            "card": r["resultCardSelector"],
            "title": r["titleSelector"],
            "link": r["jobLinkSelector"],
            "company": r["companySelector"],
            "location": r["locationSelector"],
            "salary": r["salarySelector"],
            "age": r["dateSelector"],
            "site_name": r["name"],
        }
        for r in rows
    }


def unusable_sources(raw_pages: DataFrame, selectors: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """``(source, message, pages)``: sources whose pages :func:`extract_cards` leaves out, because
    they have no selectors or one that cannot be used. Selectors are checked on the driver:
    they are configuration, one entry per site."""
    bad = {}
    for source, own in {**PORTAL_SELECTORS, **(selectors or {})}.items():
        found = [selector_error(own.get("card"))]
        found += [selector_error(s) for k, s in own.items() if s and k not in ("card", "site_name")]
        bad[source] = next((f for f in found if f), None)
    known = F.create_map(*[x for s, e in bad.items() for x in (F.lit(s), F.lit(e or ""))])
    told = F.coalesce(F.try_element_at(known, F.col("source")), F.lit("no selectors for this source"))
    return (
        raw_pages.select("source", told.alias("message"))
        .where(F.col("message") != "")
        .groupBy("source", "message")
        .agg(F.count(F.lit(1)).alias("pages"))
    )


# Addresses on the page's own host that are written out as they are: no part that goes up, is empty or is quoted.
_PLAIN_PATH = re.compile(r"/(?!/)[A-Za-z0-9_~!$&'()*+,=:@%/?-]*(?<!\?)")


_origins: dict[str, str | None] = {}


def _origin(base: str) -> str | None:
    """Scheme and host of a web address; None if they are not plain."""
    if base not in _origins:
        if len(_origins) >= 4096:
            _origins.clear()
        try:
            parts = urlsplit(base)
            plain = parts.scheme in ("http", "https") and re.fullmatch("[A-Za-z0-9.:-]+", parts.netloc)
        except ValueError:
            plain = None
        _origins[base] = f"{parts.scheme}://{parts.netloc}" if plain else None
    return _origins[base]


def _href(node: Element | None, base: str | None) -> str:
    if node is None or node.attrs.get("href") is None:
        return ""
    href = node.attrs["href"]
    if base and _PLAIN_PATH.fullmatch(href) and (origin := _origin(base)):
        return origin + href
    try:
        full = urljoin(base or "", node.attrs["href"].strip(WS_CHARS))
    except ValueError:
        return ""
    return quote(full, safe=URL_SAFE)


ARROW = {INT: pa.int32(), FLAG: pa.bool_()}


def _flat(rows: list[tuple], fields: StructType) -> list[pa.Array]:
    """Tuples as one array for each field."""
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return [pa.array(c, ARROW.get(f.dataType, pa.string())) for c, f in zip(columns, fields, strict=True)]


def _map_pages(
    pages: DataFrame, columns: list[str], read: Callable[..., Iterator[tuple]], added: str, keep: list[str],
    gathered: str | None = None,
) -> DataFrame:
    """Run ``read(*values)`` on each page and add its tuples to the page's ``keep`` columns: a row for each, or
    one row for each page with all of them in the array ``gathered``."""
    new = shape(added, pos=INT, has_next=FLAG)
    names = new.fieldNames()
    more = [StructField(gathered, ArrayType(new))] if gathered else new.fields
    schema = StructType([*[pages.schema[c] for c in keep], *more])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ends = [], [0]
            for values in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                rows.extend(read(*values))
                ends.append(len(rows))
            kept, flat = batch.select(keep), _flat(rows, new)
            if gathered:
                flat = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, names))]
            else:
                origin = [i for i, (a, b) in enumerate(zip(ends, ends[1:])) for _ in range(b - a)]
                kept = kept.take(pa.array(origin, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *flat], names=schema.names)

    wanted = list(dict.fromkeys([*keep, *columns]))
    return spread(pages.select(*wanted)).mapInArrow(job, schema)


CARD_FIELDS = (
    "pos title href company location_text salary age data_job_id entity_urn element_id"
)


def read_cards(
    raw_pages: DataFrame, selectors: dict[str, dict[str, str]] | None = None
) -> DataFrame:
    """Every page, without its address and markup, with its result cards as the array ``cards``.

    Sources that :func:`unusable_sources` names give no cards, or none of the field concerned; they never end the job.
    """
    known = {
        source: {k: v for k, v in own.items() if k == "site_name" or not v or not selector_error(v)}
        for source, own in {**PORTAL_SELECTORS, **(selectors or {})}.items()
        if not selector_error(own.get("card"))
    }

    parts = ("title", "link", "company", "location", "salary", "age")
    tests = {source: [compiled(s[p]) if s.get(p) else None for p in parts] for source, s in known.items()}

    def read(source, url, html):
        s = known.get(source)
        if s is None:
            return
        for pos, card in enumerate(select(parse(html), s["card"])):
            nodes = list(card.descendants())
            title, link, company, location, salary, age = [t and first_of(nodes, t) for t in tests[source]]
            attrs = card.attrs
            yield (
                pos, trimmed(title, ""), _href(link, url),
                trimmed(company, "") if s.get("company") else s.get("site_name", ""), trimmed(location, ""),
                trimmed(salary), trimmed(age), attrs.get("data-job-id"), attrs.get("data-entity-urn"), attrs.get("id"),
            )

    keep = [c for c in raw_pages.columns if c not in ("url", "html")]
    return _map_pages(raw_pages, ["source", "url", "html"], read, CARD_FIELDS, keep, "cards")


def extract_cards(
    raw_pages: DataFrame, selectors: dict[str, dict[str, str]] | None = None
) -> DataFrame:
    """One row per result card of :func:`read_cards`, with every column of its page but the address and markup.

    ``seq`` of the page comes out as ``page_seq``.
    """
    keep = [c for c in raw_pages.columns if c not in ("url", "html")]
    return read_cards(raw_pages, selectors).select(*keep, F.inline("cards")).withColumnRenamed("seq", "page_seq")


def extract_links(raw_pages: DataFrame, selector: str) -> DataFrame:
    """``(page_seq, pos, url)``: every non-empty link of the selector, in page order."""

    def read(url, html):
        links = (_href(n, url) for n in select(parse(html), selector))
        yield from enumerate(x for x in links if x)

    pages = raw_pages.select(F.col("seq").alias("page_seq"), F.col("url").alias("page_url"), "html")
    return _map_pages(pages, ["page_url", "html"], read, "pos url", ["page_seq"])


@F.pandas_udf(StringType())
def selector_fault(selectors: pd.Series) -> pd.Series:
    """What is wrong with a selector; null for usable and for missing ones."""
    return selectors.map(lambda s: selector_error(s) if s else None)


def extract_site_links(pages: DataFrame) -> DataFrame:
    """Links of pages that carry their site's ``jobLinkSelector`` and ``advanceSelector``.

    For each page one row with ``pos`` -1 and ``has_next``, and one for each non-empty link; all
    with the page's columns but address and markup. Pages whose selector cannot be used have no
    links.
    """

    def read(base, html, selector, advance):
        root = parse(html)
        usable = bool(advance) and not selector_error(advance)
        yield -1, "", usable and first(root, advance) is not None
        if not selector_error(selector):
            links = (_href(n, base) for n in select(root, selector))
            yield from ((i, x, False) for i, x in enumerate(x for x in links if x))

    renamed = pages.withColumnRenamed("url", "page_url")
    dropped = ("page_url", "html", "jobLinkSelector", "advanceSelector")
    keep = [c for c in renamed.columns if c not in dropped]
    return _map_pages(renamed, list(dropped), read, "pos url has_next", keep)


def extract_details(detail_pages: DataFrame, closed_references: bool = False) -> DataFrame:
    """Add ``detail`` to pages of sites with selectors.

    ``detail_pages`` has ``seq, url, html, listing_title`` and the site's ``titleSelector,
    locationSelector, descriptionSelector, applyLinkSelector``. ``closed_references`` as in :func:`parse`.
    """

    def read(url, html, title_at, location_at, description_at, apply_at):
        root = parse(html, closed_references)
        body = first(root, description_at)
        apply = url
        if apply_at and (link := first(root, apply_at)) is not None:
            apply = _href(link, url)
        yield (
            trimmed(first(root, title_at), ""),
            trimmed(first(root, location_at), ""),
            "" if body is None else body.inner_html(),
            apply,
        )

    parts = _map_pages(
        detail_pages,
        ["url", "html", "titleSelector", "locationSelector", "descriptionSelector", "applyLinkSelector"],
        read,
        "found_title found_location found_html found_apply",
        [c for c in detail_pages.columns if c != "html"],
    )
    html = F.col("found_html")
    detail = detail_struct(
        externalId=F.col("url"),
        title=falsy_or(F.col("found_title"), F.col("listing_title")),
        descriptionText=clean_text(html),
        descriptionHtml=F.nullif(html, F.lit("")),
        location=F.nullif(F.col("found_location"), F.lit("")),
        canonicalUrl=F.col("url"),
        applyUrl=F.col("found_apply"),
        rawMetadata=F.lit("{}"),
    )
    return parts.withColumn("detail", detail).drop(
        "found_title", "found_location", "found_html", "found_apply"
    )


def extract_fallback(detail_pages: DataFrame, closed_references: bool = False) -> DataFrame:
    """``(final_url, detail)`` of pages without selectors: ``(final_url, page_title, html)``. Other columns are kept.
    ``closed_references`` as in :func:`parse`."""

    def read(html):
        root = parse(html, closed_references)
        found = None
        for selector in FALLBACK_SELECTORS:
            node = first(root, selector)
            if node is not None and len(trimmed(node)) > FALLBACK_MIN_CHARS:
                found = node
                break
        if found is None:
            found = first(root, "body") or root
        yield (found.inner_html(),)

    keep = [c for c in detail_pages.columns if c != "html"]
    parts = _map_pages(detail_pages, ["html"], read, "found_html", keep)
    return parts.select(
        *[c for c in keep if c != "page_title"],
        page_detail(
            F.col("final_url"), F.col("page_title"), F.col("found_html"), clean_text(F.col("found_html"))
        ).alias("detail"),
    )
