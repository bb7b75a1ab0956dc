"""Captured job boards of registry companies to listings for ``discover``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.listings import company_career_listings, drop_seen, progress_key
from postloom.operators.ordered import small
from postloom.operators.profiles import match_profiles
from postloom.operators.progress import COMPANY_CAREERS, registry_status, resume_cursor
from postloom.operators.summary import site_errors
from postloom.schemas import SITE
from postloom.session import cut
from postloom.sources.payloads import BOARD_KINDS, site_identity, triage_payloads


@dataclass(frozen=True)
class CompanyRun:
    """``listings`` go to ``discover(career_listings=...)``. ``cursor`` is where the next run starts."""

    listings: DataFrame
    skipped: DataFrame
    errors: DataFrame
    cursor: DataFrame


def company_sites(registry: DataFrame) -> DataFrame:
    """Ready companies as sites, so that the same readers serve both."""
    ready = registry.join(registry_status(registry).select("seq", "status"), "seq").where("status = 'ready'")
    tenant, kind = F.nullif("atsTenantOrBoardId", F.lit("")), F.col("atsType")
    columns = {
        "seq": F.col("seq"),
        "id": site_id(F.col("company")),
        "name": F.col("company"),
        "url": F.col("careersUrl"),
        "adapter": kind,
        "enabled": F.lit(True),
        "greenhouse": F.struct(F.when(kind == "greenhouse", tenant).alias("boardToken")),
        "lever": F.struct(F.when(kind == "lever", tenant).alias("site")),
    }
    return ready.select(
        *[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SITE.fields]
    )


def site_id(company):
    return F.concat(F.lit(f"{COMPANY_CAREERS}::"), F.lower(company))


def company_listings(
    registry: DataFrame,
    payloads: DataFrame,
    searches: DataFrame,
    seen: DataFrame,
    keyword: str,
    location: str,
    profile: str,
    now: str,
    start: int = 0,
) -> CompanyRun:
    """One search (``keyword``, ``location``) over the companies from position ``start`` on.

    ``payloads`` are landed payloads whose ``site_id`` is ``company-careers::<company>``. Companies
    whose hiring system needs more than the registry knows are skipped, with the reason. One
    failing company never affects another; the cursor stays at the first that failed. Seen ids are
    ``company::id`` under the key of the search.
    """
    todo = cut(registry.where(F.col("seq") >= start), "companies")
    sites = cut(company_sites(todo), "company-sites")
    names = site_identity(sites).where("config_error is null")
    mine = payloads.join(small(names.select(F.col("id").alias("site_id"), "ident")), "site_id")
    verdicts = cut(
        triage_payloads(mine).select("site_id", "seq", "source_kind", "verdict", "error"), "company-verdicts"
    )
    errors = cut(site_errors(sites, verdicts), "company-errors")
    ok = mine.join(errors.select("site_id"), "site_id", "left_anti")
    rows = None
    for kind, how in BOARD_KINDS.items():
        jobs = match_profiles(how.jobs(ok.where(F.col("source_kind") == kind), None), "title", searches)
        part = how.details(jobs).select("site_id", "seq", "externalId", "title", "url", "matchedProfiles", "detail")
        rows = part if rows is None else rows.unionByName(part)
    who = small(sites.select(F.col("id").alias("site_id"), F.col("name").alias("company")))
    found = company_career_listings(rows.join(who, "site_id"), keyword, now)
    key = progress_key(F.lit(COMPANY_CAREERS), F.lit(keyword), F.lit(location))
    keyed = found.withColumns({"key": key, "role_profile": F.lit(profile)})
    fresh = drop_seen(keyed, seen, ["key"], "seen_id", ["seq"])
    failed = errors.select(F.col("site_seq").alias("seq"), F.lit(True).alias("failed"))
    attempts = todo.select("seq").join(small(failed), "seq", "left").select(
        F.lit(COMPANY_CAREERS).alias("source"), F.col("seq").alias("idx"), F.coalesce("failed", F.lit(False)).alias("failed")
    )
    skipped = registry_status(todo).where("status = 'skipped'").drop("status")
    return CompanyRun(fresh, skipped, errors, resume_cursor(attempts, ["source"], start))
