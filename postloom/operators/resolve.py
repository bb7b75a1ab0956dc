"""Listings to full postings through redirect, registry and detail tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import falsy_or, required_years
from postloom.functions.urls import ats_kind, job_id, url_host, with_canonical_url
from postloom.operators.contains import MAX_INLINE_NEEDLES, gram_matches, inline_array
from postloom.operators.ordered import lookup_join
from postloom.schemas import DETAIL, POSTING
from postloom.sources.payloads import greenhouse_details, lever_details, workday_details

REGISTRY_COLUMNS = ["company", "atsType", "atsTenantOrBoardId"]


def follow_redirects(listings: DataFrame, redirects: DataFrame) -> DataFrame:
    """Add ``final_url``. ``redirects`` has one row per ``url``."""
    known = redirects.select(F.col("url").alias("resultUrl"), F.col("final_url").alias("__final"))
    joined = lookup_join(listings, known, "resultUrl")
    return joined.withColumn("final_url", falsy_or(F.col("__final"), F.col("resultUrl"))).drop("__final")


def match_company(
    df: DataFrame,
    registry: DataFrame,
    url_col: str = "final_url",
    *,
    host_only: bool = False,
    exclude_hosts: list[str] | None = None,
    inline_limit: int = MAX_INLINE_NEEDLES,
) -> DataFrame:
    """Add ``match``: the first registry row whose domain or careers URL occurs in the URL.

    ``host_only`` looks for the domain in the host alone; ``exclude_hosts`` never match.
    """
    low, host = F.lower(url_col), url_host(F.col(url_col))
    able = host.isNotNull()
    if exclude_hosts:
        able = able & ~host.isin([h.lower() for h in exclude_hosts])
    # An empty needle names nothing; it never matches, whatever the registry's size.
    dims = registry.select(
        "seq",
        F.nullif(F.lower("corporateDomain"), F.lit("")).alias("domain"),
        F.nullif(F.lower("careersUrl"), F.lit("")).alias("careers"),
        *REGISTRY_COLUMNS,
    )
    keyed = df.withColumns({"__low": F.when(able, low), "__host": F.when(able, host)})
    text = F.col("__host") if host_only else F.col("__low")
    if dims.count() <= inline_limit:
        hits = F.filter(
            "__registry",
            lambda r: F.coalesce(text.contains(r["domain"]), F.lit(False))
            | (F.lit(False) if host_only else F.coalesce(text.contains(r["careers"]), F.lit(False))),
        )
        first = F.try_element_at(hits, F.lit(1))
        match = F.struct(*[first[c].alias(c) for c in ["seq", *REGISTRY_COLUMNS]])
        ready = keyed.withColumn(
            "__registry", inline_array(dims, "domain", "careers", *REGISTRY_COLUMNS)
        )
        return ready.withColumn("match", F.when(first.isNotNull(), match)).drop(
            "__low", "__host", "__registry"
        )
    urls = keyed.select("__low", "__host").where(F.col("__low").isNotNull()).distinct()
    needles = dims.select("seq", F.col("domain").alias("needle"))
    if not host_only:
        needles = needles.unionByName(dims.select("seq", F.col("careers").alias("needle")))
    by_url = gram_matches(urls, "__host" if host_only else "__low", needles, "needle")
    hits = by_url.join(needles, "needle").groupBy("text").agg(F.min("seq").alias("seq"))
    first = hits.join(dims.drop("domain", "careers"), "seq").select(
        F.col("text").alias("__host" if host_only else "__low"),
        F.struct("seq", *REGISTRY_COLUMNS).alias("match"),
    )
    return lookup_join(keyed, first, "__host" if host_only else "__low").drop("__low", "__host")


def with_final_ats(df: DataFrame, url_col: str = "final_url") -> DataFrame:
    """Add ``ats``: the registry's kind, else the one recognised from the URL."""
    return df.withColumn("ats", falsy_or(F.col("match.atsType"), ats_kind(F.col(url_col))))


def detail_struct(**values: Column) -> Column:
    return F.struct(
        *[values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in DETAIL.fields]
    )


def page_detail(url: Column, title: Column, html: Column, text: Column) -> Column:
    """Detail of a page read without selectors."""
    return detail_struct(
        externalId=url,
        title=falsy_or(title, F.lit("Job Posting")),
        descriptionText=text,
        descriptionHtml=F.nullif(html, F.lit("")),
        location=F.lit("Remote/Various"),
        canonicalUrl=url,
        applyUrl=url,
        rawMetadata=F.lit("{}"),
    )


def stub_detail() -> Column:
    """What is known from the listing alone."""
    return detail_struct(
        externalId=falsy_or(F.col("sourceJobId"), F.col("final_url")),
        title=F.col("title"),
        descriptionText=F.concat(
            F.lit("Job posting found on "), F.col("source"), F.lit(". Full description not extracted.")
        ),
        location=F.col("location"),
        requisitionId=F.col("sourceJobId"),
        salaryText=F.col("salarySnippet"),
        canonicalUrl=F.col("final_url"),
        applyUrl=F.col("final_url"),
        rawMetadata=F.lit("{}"),
    )


def attach_details(
    listings: DataFrame, detail_payloads: DataFrame, page_details: DataFrame, on: str = "final_url"
) -> DataFrame:
    """Add ``detail`` and ``resolve_error``.

    ``detail_payloads`` is ``(final_url, ats, body)`` and ``page_details`` is ``(final_url,
    detail)``, one row per URL each. Details are worked out once per URL and then looked up.
    Captures that belong to single listings have a column ``on`` as well and one row per value of it: listings of
    one URL then keep their own. The order of preference is hiring system, captured page, listing stub.
    """
    bodies = detail_payloads.where(F.try_parse_json("body").isNotNull())
    urls = bodies.select(
        F.col(on).alias("__on"), "final_url", "ats", F.col("final_url").alias("url"), F.col("body").alias("raw"), "body",
        F.lit(None).cast("string").alias("title"),
    )
    greenhouse = greenhouse_details(
        urls.where(F.col("ats") == "greenhouse").withColumn("externalId", F.col("final_url"))
    )
    lever = lever_details(urls.where(F.col("ats") == "lever").withColumn("externalId", F.col("final_url")))
    workday = workday_details(
        urls.where(F.col("ats") == "workday").withColumn(
            "externalId", F.element_at(F.split("final_url", "/"), -1)
        )
    )
    known = greenhouse.select("__on", F.col("ats").alias("__kind"), F.col("detail").alias("__ats"))
    for part in (lever, workday):
        known = known.unionByName(
            part.select("__on", F.col("ats").alias("__kind"), F.col("detail").alias("__ats"))
        )
    pages = page_details.select(F.col(on).alias("__on"), F.col("detail").alias("__page"))
    found = known.join(pages, "__on", "full").withColumnRenamed("__on", on)
    joined = lookup_join(listings, found, on)
    api = F.when(F.col("__kind") == F.col("ats"), F.col("__ats"))
    url = F.col("final_url")
    empty_greenhouse = detail_struct(
        externalId=url, descriptionText=F.lit(""), requisitionId=url, canonicalUrl=url, applyUrl=url,
        rawMetadata=F.lit("{}"),
    )
    lost_lever = (F.col("ats") == "lever") & api["canonicalUrl"].isNull()
    detail = (
        F.when(F.col("ats") == "lever", api)
        .when(F.col("ats") == "greenhouse", F.coalesce(api, empty_greenhouse))
        .when(api.isNotNull(), api)
        .otherwise(F.coalesce(F.col("__page"), stub_detail()))
    )
    return joined.withColumns(
        {
            "detail": detail,
            "resolve_error": F.when(lost_lever, F.lit("posting detail has no URL")),
        }
    ).drop("__kind", "__ats", "__page")


def assemble_resolved(rows: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Resolved postings, and the listings that could not be resolved with their error."""
    d, m = F.col("detail"), F.col("match")
    good = rows.where(F.col("resolve_error").isNull()).withColumn("__given_url", d["canonicalUrl"])
    good = with_canonical_url(good, "__given_url", "__key")
    matched = m.isNotNull()
    columns = {
        "id": job_id(F.col("__key")),
        "source": F.when(matched, F.concat(F.lit("company-careers::"), F.lower(m["company"]))).otherwise(
            F.col("source")
        ),
        "sourceType": F.when(matched, "company-careers").otherwise("portal"),
        "company": F.coalesce(m["company"], F.col("company")),
        "title": falsy_or(d["title"], F.col("title")),
        "location": falsy_or(d["location"], F.col("location")),
        "remoteType": F.lit(None).cast("string"),
        "requisitionId": falsy_or(d["requisitionId"], F.col("sourceJobId")),
        "discoveredAt": F.lit(now),
        "lastSeenAt": F.lit(now),
        "requiredYears": required_years(d["descriptionText"]),
        "salaryText": falsy_or(d["salaryText"], F.col("salarySnippet")),
        "matchedProfiles": F.col("matchedProfiles"),
        "discoveredFrom": F.array("source"),
        "discoveredUrl": F.col("resultUrl"),
        "rawMetadata": F.coalesce(d["rawMetadata"], F.lit("{}")),
    }
    postings = good.select("seq", *[columns.get(c, d[c]).alias(c) for c in POSTING.fieldNames()])
    errors = rows.where(F.col("resolve_error").isNotNull()).select(
        "seq", "source", "resultUrl", "final_url", "resolve_error"
    )
    return postings, errors
