"""Crawl planning and resumable progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.urls import search_url
from postloom.operators.listings import progress_key
from postloom.operators.ordered import shuffled, spread
from postloom.schemas import PROGRESS

DEFAULT_LOCATION = "United States"
# The portals searched besides the sites in the configuration.
STANDARD_PORTALS = ["google-jobs", "indeed", "monster", "linkedin-public"]
COMPANY_CAREERS = "company-careers"


def target_sources(sites: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """``(seq, source, template)``: portals, company careers, then enabled generic sites.

    ``wanted`` filters by name, ignoring case; the exact word ``generic`` stands for all
    generic sites.
    """
    spark = sites.sparkSession
    names = [*STANDARD_PORTALS, COMPANY_CAREERS]
    fixed = spark.createDataFrame(
        [(i, name, False) for i, name in enumerate(names)], "seq bigint, source string, generic boolean"
    ).withColumn("template", F.lit(None).cast("string"))
    generic = sites.where(F.col("enabled") & (F.col("adapter") == "generic")).select(
        (F.col("seq") + len(names)).alias("seq"),
        F.col("id").alias("source"),
        F.lit(True).alias("generic"),
        F.coalesce("generic.searchUrlTemplate", "url").alias("template"),
    )
    sources = fixed.unionByName(generic)
    if wanted:
        low = [w.lower() for w in wanted]
        keep = F.lower("source").isin(low)
        if "generic" in wanted:
            keep = keep | F.col("generic")
        sources = sources.where(keep)
    return sources.drop("generic")


def crawl_frontier(
    sources: DataFrame,
    roles: DataFrame,
    progress: DataFrame,
    location: str | None = None,
    profiles: list[str] | None = None,
) -> DataFrame:
    """Work items still open: every source with every role keyword, minus completed keys."""
    if profiles is not None:
        roles = roles.where(F.col("profile").isin(profiles))
    words = roles.select("seq", "profile", F.posexplode("keywords").alias("pos", "keyword"))
    todo = words.agg(
        F.array_sort(F.collect_list(F.struct(F.col("seq").alias("role_seq"), "pos", "keyword", "profile")))
    ).scalar()
    # A source becomes a row for every keyword, so few sources are dealt out first.
    items = spread(sources).select(
        F.col("seq").alias("source_seq"), "source", F.explode(todo).alias("w")
    ).select("source_seq", "source", "w.*", F.lit(location or DEFAULT_LOCATION).alias("location"))
    keyed = items.withColumn(
        "key", progress_key(F.col("source"), F.col("keyword"), F.col("location"))
    )
    done = progress.where("completed").select("key")
    at = progress.select("key", "lastPage")
    return (
        keyed.join(done, "key", "left_anti")
        .join(at, "key", "left")
        .withColumn("start_page", F.coalesce("lastPage", F.lit(0)) + 1)
        .drop("lastPage")
    )


def search_urls(frontier: DataFrame, max_pages: int, template_col: str | None = None) -> DataFrame:
    """One row per page to capture, with its address."""
    pages = frontier.where(F.col("start_page") <= max_pages).withColumn(
        "page_no", F.explode(F.sequence(F.col("start_page"), F.lit(max_pages)))
    )
    template = F.col(template_col) if template_col else None
    return pages.withColumn(
        "url", search_url(F.col("source"), F.col("keyword"), F.col("location"), F.col("page_no"), template)
    )


def progress_rollup(pages: DataFrame, prior: DataFrame, now: str) -> DataFrame:
    """Prior progress updated with this run's pages.

    ``pages`` has ``(key, source, keyword, location, page_no, failed)``, one row per page
    recorded. A key is completed when none of its pages failed. A search that had no result is
    one row without a page number: it is completed and its last page stays where it was.
    """
    run = pages.groupBy("key").agg(
        F.min_by(
            F.struct("source", "keyword", "location"), F.coalesce("page_no", F.lit(1 << 30))
        ).alias("who"),
        F.max(F.when(~F.col("failed"), F.col("page_no"))).alias("run_page"),
        F.bool_and(~F.col("failed")).alias("run_done"),
    )
    joined = prior.join(shuffled(run), "key", "full")
    updated = F.col("who").isNotNull()
    columns = {
        "key": F.col("key"),
        "lastPage": F.coalesce("run_page", "lastPage", F.lit(0)).cast("int"),
        "completed": F.coalesce("run_done", "completed"),
        "lastUpdated": F.when(updated, F.lit(now)).otherwise(F.col("lastUpdated")),
    }
    return joined.select(
        *[
            columns.get(c, F.coalesce(c, f"who.{c}")).alias(c)
            for c in PROGRESS.fieldNames()
        ]
    )


def seen_rollup(listings: DataFrame, prior: DataFrame, id_col: str = "sourceJobId") -> DataFrame:
    """Seen ids as one row each, oldest appearance kept; never gathered into one value per key."""
    new = listings.where(F.coalesce(F.col(id_col), F.lit("")) != "").select(
        "key", F.col(id_col).alias("source_job_id"), F.col("seq").alias("first_seq")
    )
    return prior.unionByName(new).groupBy("key", "source_job_id").agg(F.min("first_seq").alias("first_seq"))


def registry_status(registry: DataFrame) -> DataFrame:
    """Each company as ready or skipped, with the reason and the field that is missing."""
    kind = F.col("atsType")
    return registry.select(
        "seq",
        "company",
        "atsType",
        F.when(kind.isin("workday", "generic"), "skipped").otherwise("ready").alias("status"),
        F.when(kind == "workday", "missing verified Workday ATS site identifier")
        .when(kind == "generic", "missing verified generic-portal selectors")
        .alias("reason"),
        F.when(kind == "workday", "atsWorkdaySite")
        .when(kind == "generic", "genericSelectors")
        .alias("missing_field"),
    )


def registry_coverage(registry: DataFrame) -> DataFrame:
    """``(ready, skipped, total)``."""
    status = F.col("status")
    return registry_status(registry).agg(
        F.count_if(status == "ready").alias("ready"),
        F.count_if(status == "skipped").alias("skipped"),
        F.count(F.lit(1)).alias("total"),
    )


def resume_cursor(attempts: DataFrame, keys: list[str], start: int = 0) -> DataFrame:
    """``(keys, cursor)``: index of the first failed company, else one past the last attempted.

    ``attempts`` has ``idx`` and ``failed``; structural skips count as attempted.
    """
    return attempts.groupBy(*keys).agg(
        F.coalesce(
            F.min(F.when(F.col("failed"), F.col("idx"))), F.max("idx") + 1, F.lit(start)
        ).alias("cursor")
    )
