"""Captured API responses to postings: triage, parsing and mapping per source kind."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.text import challenge_page, challenge_reason, clean_text, required_years
from postloom.functions.urls import board_token, job_id, lever_slug, with_canonical_url
from postloom.operators.ordered import first_n_in_key, ordered_union, small
from postloom.schemas import POSTING
from postloom.session import cut

# A payload's rows are numbered ``payload seq * ROWS_PER_PAYLOAD + position``.
ROWS_PER_PAYLOAD = 1 << 20

GREENHOUSE_JOB = (
    "struct<id:string,title:string,absolute_url:string,location:struct<name:string>,"
    "departments:array<struct<name:string>>,content:string,updated_at:string>"
)
LEVER_JOB = (
    "struct<id:string,text:string,categories:struct<commitment:string,location:string,team:string,"
    "department:string>,hostedUrl:string,applyUrl:string,description:string,"
    "descriptionPlain:string,createdAt:bigint>"
)
WORKDAY_PAGE = "struct<total:bigint,jobPostings:array<struct<title:string,externalPath:string>>>"
WORKDAY_INFO = (
    "struct<title:string,jobDescription:string,location:string,timeType:string,jobReqId:string,"
    "startDate:string>"
)


def position_seq(payload_seq: Column, position: Column) -> Column:
    """Numbers of the next payload must not be reached: a larger payload is an error."""
    fits = position < ROWS_PER_PAYLOAD
    error = F.raise_error(F.lit(f"a payload or page has more than {ROWS_PER_PAYLOAD} rows"))
    return F.when(fits, payload_seq * F.lit(ROWS_PER_PAYLOAD) + position).otherwise(error.cast("long"))


def _first(array: Column, n: int | None) -> Column:
    return array if n is None else F.slice(array, 1, n)


def site_identity(sites: DataFrame) -> DataFrame:
    """Add ``ident`` (board token, slug or tenant) and ``config_error`` to each site."""
    token = board_token(F.col("url"), F.col("greenhouse.boardToken"))
    slug = lever_slug(F.col("url"), F.col("lever.site"))
    ident = (
        F.when(F.col("adapter") == "greenhouse", token)
        .when(F.col("adapter") == "lever", slug)
        .when(F.col("adapter") == "workday", F.col("workday.tenant"))
    )
    # Names of required selectors, and the wording of the errors.
    required = [
        "searchInputSelector", "searchButtonSelector", "resultCardSelector", "jobLinkSelector",
        "titleSelector", "locationSelector", "descriptionSelector",
    ]
    name = F.concat(F.lit('"'), F.col("id"), F.lit('"'))
    missing = F.coalesce(
        *[F.when(F.coalesce(F.col(f"generic.{k}"), F.lit("")) == "", F.lit(k)) for k in required]
    )
    error = (
        F.when(
            (F.col("adapter") == "greenhouse") & ident.isNull(),
            F.concat(
                F.lit("Cannot determine Greenhouse board token for site "), name,
                F.lit(" - set site.greenhouse.boardToken"),
            ),
        )
        .when(
            (F.col("adapter") == "lever") & ident.isNull(),
            F.concat(F.lit("Cannot determine Lever site slug for "), name, F.lit(" - set site.lever.site")),
        )
        .when(
            (F.col("adapter") == "workday") & F.col("workday").isNull(),
            F.concat(
                F.lit("Site "), name,
                F.lit(' uses adapter "workday" but has no workday config block (hostname/tenant/site)'),
            ),
        )
        .when(
            (F.col("adapter") == "generic") & F.col("generic").isNull(),
            F.concat(
                F.lit("Site "), name,
                F.lit(' uses adapter "generic" but has no generic selector block configured'),
            ),
        )
        .when(
            (F.col("adapter") == "generic") & missing.isNotNull(),
            F.concat(
                F.lit("Site "), name, F.lit(' generic config missing required selector "'), missing, F.lit('"')
            ),
        )
    )
    return sites.withColumns({"ident": ident, "config_error": error})


def triage_payloads(payloads: DataFrame) -> DataFrame:
    """Add ``verdict`` (ok / challenge / not_json / bad_shape / unknown_kind) and ``error``.

    ``payloads`` carries ``source_kind`` (greenhouse, lever, workday, workday_detail), ``body``
    and ``ident``, the name used in messages. The first failing check wins.
    """
    page = challenge_page(F.lit(None).cast("string"), F.col("body"))
    parsed = F.try_parse_json("body")
    kind = F.col("source_kind")
    is_list = lambda path: F.try_variant_get(F.col("__json"), path, "array<variant>").isNotNull()
    total = F.schema_of_variant(F.try_variant_get(F.col("__json"), "$.total", "variant"))
    shape_ok = (
        F.when(kind == "greenhouse", is_list("$.jobs"))
        .when(kind == "lever", is_list("$"))
        .when(
            kind == "workday",
            is_list("$.jobPostings") & F.coalesce(total.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.lit(False)),
        )
        .otherwise(F.lit(True))
    )
    known = F.coalesce(kind.isin("greenhouse", "lever", "workday", "workday_detail"), F.lit(False))
    paged = payloads.withColumns({"__page": page, "__json": parsed})
    marked = paged.withColumn("__reason", challenge_reason(F.col("__page"))).drop("__page")
    verdict = (
        F.when(~known, "unknown_kind")
        .when(F.col("__reason").isNotNull(), "challenge")
        .when(F.col("__json").isNull(), "not_json")
        .when(~shape_ok, "bad_shape")
        .otherwise("ok")
    )
    quoted = F.concat(F.lit('"'), F.coalesce("ident", F.lit("")), F.lit('"'))
    label = (
        F.when(kind == "greenhouse", F.concat(F.lit("Greenhouse board "), quoted))
        .when(kind == "lever", F.concat(F.lit("Lever site "), quoted))
        .when(kind == "workday_detail", F.concat(F.lit("Workday job detail "), quoted))
        .otherwise(F.concat(F.lit("Workday tenant "), quoted))
    )
    verb = F.when(kind.isin("greenhouse", "lever"), "fetching ").otherwise("on ")
    # The wording of errors is part of the surveyed behaviour.
    shape_word = F.when(kind == "workday", "unrecognized").otherwise("unexpected")
    v = F.col("verdict")
    error = (
        F.when(
            v == "challenge",
            F.concat(F.lit("Verification required "), verb, label, F.lit(": "), F.col("__reason")),
        )
        .when(
            v == "unknown_kind",
            F.concat(F.lit("No reader for payloads of kind "), F.coalesce(kind, F.lit("(none)"))),
        )
        .when(v == "not_json", F.concat(label, F.lit(" returned a non-JSON response")))
        .when(
            v == "bad_shape",
            F.concat(label, F.lit(" returned an "), shape_word, F.lit(" response shape")),
        )
    )
    return marked.withColumn("verdict", verdict).withColumn("error", error).drop("__reason", "__json")


def greenhouse_jobs(payloads: DataFrame, max_jobs: int | None = None) -> DataFrame:
    """Board payload to one row per job; the raw element is kept as JSON text.

    A payload is one whole answer of its site, so the cap, if set, is a slice of its array.
    """
    board = F.from_json("body", "struct<jobs:array<string>>")
    jobs = _first(board["jobs"], max_jobs)
    rows = payloads.select("site_id", "seq", F.posexplode(jobs).alias("pos", "raw"))
    job = F.from_json("raw", GREENHOUSE_JOB)
    return rows.select("site_id", "seq", "pos", "raw", job.alias("job")).select(
        "site_id",
        position_seq(F.col("seq"), F.col("pos")).alias("seq"),
        F.col("job.id").alias("externalId"),
        F.col("job.title").alias("title"),
        F.col("job.absolute_url").alias("url"),
        "raw",
        "job",
    )


def lever_jobs(payloads: DataFrame, max_jobs: int | None = None) -> DataFrame:
    jobs = _first(F.from_json("body", "array<string>"), max_jobs)
    rows = payloads.select("site_id", "seq", F.posexplode(jobs).alias("pos", "raw"))
    job = F.from_json("raw", LEVER_JOB)
    return rows.select("site_id", "seq", "pos", "raw", job.alias("job")).select(
        "site_id",
        position_seq(F.col("seq"), F.col("pos")).alias("seq"),
        F.col("job.id").alias("externalId"),
        F.col("job.text").alias("title"),
        F.col("job.hostedUrl").alias("url"),
        "raw",
        "job",
    )


def total_stop(
    pages: DataFrame, max_pages: int | None = None, max_jobs: int | None = None
) -> DataFrame:
    """Search pages that would have been read, from ``(site_id, search_no, page_no, total, paths)``.

    A search ends before an empty page, after the page that reaches the reported total, or
    after the page on which the site's distinct paths reach the cap, if there is one.

    The rules are worked out on thin rows, one per page; the paths are fetched for the pages
    that were read.
    """
    at = ["site_id", "search_no", "page_no"]
    thin = cut(
        cap_pages(pages, max_pages).select(*at, "total", F.size("paths").alias("n")), "search-pages"
    )
    read = _until_total(thin, F.col("n")).select(*at)
    if max_jobs is not None:
        with_paths = pages.select(*at, "paths").join(read, at)
        read = _until_jobs(with_paths, max_jobs)
    return pages.join(read, at, "left_semi")


def _until_jobs(read: DataFrame, max_jobs: int) -> DataFrame:
    """``(site_id, search_no, page_no)`` up to the page that reaches the cap of its site."""
    # Distinct paths are counted where they first appear among the pages still read.
    paths = read.select("site_id", "search_no", "page_no", F.explode("paths").alias("path"))
    first = paths.groupBy("site_id", "path").agg(F.min(F.struct("search_no", "page_no")).alias("at"))
    fresh = first.groupBy("site_id", "at").agg(F.count(F.lit(1)).alias("__fresh")).select(
        "site_id", F.col("at.search_no").alias("search_no"), F.col("at.page_no").alias("page_no"), "__fresh"
    )
    site_order = Window.partitionBy("site_id").orderBy("search_no", "page_no")
    running = site_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = ["site_id", "search_no", "page_no"]
    counted = read.select(*at).join(fresh, at, "left").withColumn(
        "__distinct", F.sum(F.coalesce("__fresh", F.lit(0))).over(running)
    )
    within = Window.partitionBy("site_id", "search_no").orderBy("page_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    hit = F.coalesce(F.max((F.col("__distinct") >= max_jobs).cast("int")).over(within), F.lit(0))
    return counted.withColumn("__hit", hit).where(F.col("__hit") == 0).select(*at)


def _until_total(pages: DataFrame, n: Column) -> DataFrame:
    order = Window.partitionBy("site_id", "search_no").orderBy("page_no")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = pages.withColumn("__seen", F.sum(n).over(running))
    ended = F.coalesce(F.max((F.col("__seen") >= F.col("total")).cast("int")).over(earlier), F.lit(0))
    empty = F.max((n == 0).cast("int")).over(running)
    return (
        seen.withColumns({"__ended": ended, "__empty": empty})
        .where((F.col("__ended") == 0) & (F.col("__empty") == 0))
        .drop("__seen", "__ended", "__empty")
    )


def collapse_first_seen(
    rows: DataFrame, keys: list[str], order_col: str, array_col: str, last_cols: list[str]
) -> DataFrame:
    """One row per key: first position, last value of ``last_cols``, ordered union of tags."""
    facts = rows.groupBy(*keys).agg(
        F.min(order_col).alias(order_col),
        *([F.max_by(F.struct(*last_cols), order_col).alias("__last")] if last_cols else []),
    )
    unions = ordered_union(rows, keys, [array_col], [order_col])
    joined = facts.join(unions, keys)
    return joined.select(
        *keys, order_col, *[F.col(f"__last.{c}").alias(c) for c in last_cols], array_col
    )


def workday_jobs(
    payloads: DataFrame,
    sites: DataFrame,
    searches: DataFrame,
    max_pages: int | None = None,
    max_jobs: int | None = None,
) -> DataFrame:
    """Search pages to one row per external path, with the profiles of every search that found it.

    ``searches`` is ``(search_no, keyword, profileIds)``. Pages captured for other keywords are
    left out. Only if there are no searches at all, all pages count as the unfiltered search.
    """
    unfiltered = searches.isEmpty()
    parsed = payloads.select(
        "site_id", "seq", "page_no", F.coalesce("request_keyword", F.lit("")).alias("keyword"),
        F.from_json("body", WORKDAY_PAGE).alias("p"),
    )
    tagged = parsed.join(small(searches), "keyword", "left" if unfiltered else "inner").select(
        "site_id", "seq", "page_no",
        F.coalesce("search_no", F.lit(-1)).alias("search_no"),
        F.coalesce("profileIds", F.array().cast("array<string>")).alias("matchedProfiles"),
        F.col("p.total").alias("total"),
        F.col("p.jobPostings").alias("postings"),
        F.col("p.jobPostings.externalPath").alias("paths"),
    )
    read = total_stop(tagged, max_pages, max_jobs)
    rows = read.select(
        "site_id", "seq", "matchedProfiles", F.posexplode("postings").alias("pos", "j")
    ).select(
        "site_id",
        position_seq(F.col("seq"), F.col("pos")).alias("seq"),
        F.col("j.externalPath").alias("externalId"),
        F.col("j.title").alias("title"),
        "matchedProfiles",
    )
    jobs = collapse_first_seen(rows, ["site_id", "externalId"], "seq", "matchedProfiles", ["title"])
    where = sites.select(F.col("id").alias("site_id"), "workday")
    url = F.format_string(
        "https://%s/%s/job/%s", F.col("workday.hostname"), F.col("workday.site"), F.col("externalId")
    )
    return jobs.join(small(where), "site_id").withColumn("url", url).drop("workday")


def greenhouse_details(jobs: DataFrame) -> DataFrame:
    """Adds ``detail``. ``jobs`` has ``externalId``, ``url`` and ``raw``, and may have the parsed ``job``, which is not kept."""
    job = F.col("job") if "job" in jobs.columns else F.from_json("raw", GREENHOUSE_JOB)
    j = F.col("__job")
    # The cleaned text is a column of its own, so that later uses of it do not repeat the work.
    read = jobs.withColumn("__job", job).withColumn("__text", clean_text(F.coalesce(j["content"], F.lit(""))))
    return read.withColumn(
        "detail",
        F.struct(
            F.col("externalId"),
            j["title"].alias("title"),
            F.col("__text").alias("descriptionText"),
            j["content"].alias("descriptionHtml"),
            j["location"]["name"].alias("location"),
            F.try_element_at(j["departments"], F.lit(1))["name"].alias("department"),
            F.lit(None).cast("string").alias("employmentType"),
            F.col("externalId").alias("requisitionId"),
            j["updated_at"].alias("postingDate"),
            F.lit(None).cast("string").alias("salaryText"),
            F.col("url").alias("canonicalUrl"),
            F.col("url").alias("applyUrl"),
            F.col("raw").alias("rawMetadata"),
        ),
    ).drop("__job", "__text", "job")


def iso_millis(millis: Column) -> Column:
    """Epoch milliseconds as an ISO instant; null and zero give null (session zone must be UTC)."""
    return F.when(
        millis != 0, F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    )


def lever_details(jobs: DataFrame) -> DataFrame:
    job = F.col("job") if "job" in jobs.columns else F.from_json("raw", LEVER_JOB)
    j = F.col("__job")
    text = clean_text(F.coalesce(j["descriptionPlain"], j["description"], F.lit("")))
    return jobs.withColumn("__job", job).withColumn("__text", text).withColumn(
        "detail",
        F.struct(
            F.col("externalId"),
            j["text"].alias("title"),
            F.col("__text").alias("descriptionText"),
            j["description"].alias("descriptionHtml"),
            j["categories"]["location"].alias("location"),
            F.coalesce(j["categories"]["team"], j["categories"]["department"]).alias("department"),
            j["categories"]["commitment"].alias("employmentType"),
            F.col("externalId").alias("requisitionId"),
            iso_millis(j["createdAt"]).alias("postingDate"),
            F.lit(None).cast("string").alias("salaryText"),
            j["hostedUrl"].alias("canonicalUrl"),
            j["applyUrl"].alias("applyUrl"),
            F.col("raw").alias("rawMetadata"),
        ),
    ).drop("__job", "__text", "job")


def workday_details(jobs: DataFrame) -> DataFrame:
    """``jobs`` has ``externalId``, ``title``, ``url`` and the detail ``body`` (null: all defaults)."""
    info = F.from_json(F.get_json_object("body", "$.jobPostingInfo"), WORKDAY_INFO)
    i = F.col("__info")
    html = F.coalesce(i["jobDescription"], F.lit(""))
    return jobs.withColumn("__info", info).withColumn("__text", clean_text(html)).withColumn(
        "detail",
        F.struct(
            F.col("externalId"),
            F.coalesce(i["title"], F.col("title")).alias("title"),
            F.col("__text").alias("descriptionText"),
            F.nullif(html, F.lit("")).alias("descriptionHtml"),
            i["location"].alias("location"),
            F.lit(None).cast("string").alias("department"),
            i["timeType"].alias("employmentType"),
            F.coalesce(i["jobReqId"], F.col("externalId")).alias("requisitionId"),
            i["startDate"].alias("postingDate"),
            F.lit(None).cast("string").alias("salaryText"),
            F.col("url").alias("canonicalUrl"),
            F.col("url").alias("applyUrl"),
            F.coalesce(F.get_json_object("body", "$.jobPostingInfo"), F.lit("{}")).alias("rawMetadata"),
        ),
    ).drop("__info", "__text", "body")


def normalise_postings(details: DataFrame, sites: DataFrame, now: str) -> DataFrame:
    """Details of one site each to postings. Rows carry ``site_id``, ``seq``, ``detail``, tags."""
    who = small(
        sites.select(
            F.col("id").alias("site_id"), F.col("name").alias("company"), F.col("adapter").alias("sourceType")
        )
    )
    d = F.col("detail")
    rows = details.join(who, "site_id").withColumn("__given_url", d["canonicalUrl"])
    rows = with_canonical_url(rows, "__given_url", "__key")
    columns = {
        "id": job_id(F.col("__key")),
        "source": F.col("site_id"),
        "remoteType": F.lit(None).cast("string"),
        "discoveredAt": F.lit(now),
        "lastSeenAt": F.lit(now),
        "requiredYears": required_years(d["descriptionText"]),
        "discoveredFrom": F.array("site_id"),
        "discoveredUrl": F.lit(None).cast("string"),
        "sourceType": F.col("sourceType"),
        "company": F.col("company"),
        "matchedProfiles": F.col("matchedProfiles"),
    }
    return rows.select("seq", *[columns.get(c, d[c]).alias(c) for c in POSTING.fieldNames()])


def cap_per_source(df: DataFrame, n: int | None, key: str = "site_id") -> DataFrame:
    """First ``n`` rows per source in arrival order; all without a cap."""
    if n is None:
        return df
    return first_n_in_key(df, [key], "seq", n)


def cap_pages(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.where(F.col("page_no") <= n)


def take_first(df: DataFrame, n: int | None) -> DataFrame:
    """The run limit: the first ``n`` rows of a batch. Never applied to the store."""
    if n is None:
        return df
    if n < 1:
        raise ValueError("limit must be a positive integer")
    return df.orderBy("seq").limit(n)


@dataclass(frozen=True)
class SourceKind:
    """How one kind of source turns its payloads into jobs, and jobs into details."""

    jobs: Callable[[DataFrame, int | None], DataFrame]
    details: Callable[[DataFrame], DataFrame]


# Kinds whose single payload holds everything. Add an entry to support another such source.
BOARD_KINDS = {
    "greenhouse": SourceKind(greenhouse_jobs, greenhouse_details),
    "lever": SourceKind(lever_jobs, lever_details),
}
