"""Configured sites to store: payloads are triaged, parsed, normalised and merged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.merge import merge_with_keys
from postloom.operators.ordered import number_rows, small
from postloom.operators.profiles import match_profiles, profile_totals, role_searches
from postloom.operators.summary import run_summary, site_errors
from postloom.plans.generic import generic_jobs as read_generic
from postloom.plans.generic import selector_errors
from postloom.session import cut
from postloom.sources.payloads import (
    BOARD_KINDS,
    ROWS_PER_PAYLOAD,
    cap_per_source,
    normalise_postings,
    position_seq,
    site_identity,
    take_first,
    triage_payloads,
    workday_details,
    workday_jobs,
)


@dataclass(frozen=True)
class RunResult:
    store: DataFrame
    keys: DataFrame
    batch: DataFrame
    summary: DataFrame
    totals: DataFrame
    errors: DataFrame


def collect(
    sites: DataFrame,
    roles: DataFrame,
    payloads: DataFrame,
    store: DataFrame | None,
    now: str,
    *,
    site_ids: list[str] | None = None,
    profiles: list[str] | None = None,
    limit: int | None = None,
    store_keys: DataFrame | None = None,
    generic_jobs: DataFrame | None = None,
    generic_pages: DataFrame | None = None,
    generic_details: DataFrame | None = None,
    max_pages: int | None = None,
    max_jobs: int | None = None,
) -> RunResult:
    """One run over landed payloads.

    Postings come in the order of the sites, then of their payloads, then of their place in the
    payload; so the run limit takes the first sites first. ``max_pages`` and ``max_jobs`` are
    settings: without them nothing is left out.

    ``generic_pages`` and ``generic_details`` are captured result and job pages of generic sites
    (see :func:`postloom.plans.generic.generic_jobs`); ``generic_jobs`` holds already extracted
    ones: ``site_id, seq, url, matchedProfiles, detail``. Payloads and pages of a run are numbered
    together, each with a number of its own; an extracted job's ``seq`` is its page's number and its place.
    """
    wanted = sites.where("enabled")
    if site_ids is not None:
        wanted = wanted.where(F.col("id").isin(site_ids))
    wanted = cut(wanted, "sites")
    searches = cut(role_searches(roles, profiles), "searches")
    names = site_identity(wanted).where("config_error is null")
    captures = [payloads]
    if generic_pages is not None and generic_details is not None:
        captures.append(generic_pages)
    if generic_jobs is not None:
        captured = F.floor(F.col("seq") / ROWS_PER_PAYLOAD).cast("long")
        captures.append(generic_jobs.withColumn("__at", F.col("seq") % ROWS_PER_PAYLOAD).withColumn("seq", captured))
    ordered = all_in_site_order(captures, wanted)
    mine = ordered[0]
    if generic_jobs is not None:
        jobs = ordered.pop()
        generic_jobs = jobs.withColumn("seq", position_seq(F.col("seq"), F.col("__at"))).drop("__at")
    if len(ordered) > 1:
        generic_pages = ordered[1]
    mine = mine.join(small(names.select(F.col("id").alias("site_id"), "ident")), "site_id")
    # Verdicts are kept without the bodies; the few bad payloads are then left out by number.
    verdicts = cut(
        triage_payloads(mine).select("site_id", "seq", "source_kind", "request_keyword", "verdict", "error"),
        "verdicts",
    )
    errors = _without_generic_silence(site_errors(wanted, verdicts), wanted)
    told = errors.select("site_id")
    errors = errors.unionByName(selector_errors(wanted).join(told, "site_id", "left_anti"))
    errors = cut(errors, "site-errors")
    bad = verdicts.where(F.col("verdict") != "ok")
    stopped = errors.where("list_failed").select("site_id")
    ok = mine.join(bad.select("seq"), "seq", "left_anti").join(small(stopped), "site_id", "left_anti")

    parts = []
    for kind, how in BOARD_KINDS.items():
        jobs = how.jobs(ok.where(F.col("source_kind") == kind), max_jobs)
        jobs = match_profiles(jobs, "title", searches)
        parts.append(how.details(jobs).select("site_id", "seq", "matchedProfiles", "detail"))
    searched = ok.where(F.col("source_kind") == "workday")
    paths = cut(workday_jobs(searched, wanted, searches, max_pages, max_jobs), "workday-jobs")
    found = cap_per_source(paths, max_jobs)
    # A detail response names its job in request_keyword. The first bad one ends its site.
    detail = F.col("source_kind") == "workday_detail"
    broken = bad.where(detail).select("site_id", F.col("request_keyword").alias("externalId"))
    stop = found.join(broken, ["site_id", "externalId"]).groupBy("site_id").agg(F.min("seq").alias("stop_seq"))
    answers = ok.where(detail).select("site_id", F.col("request_keyword").alias("externalId"), "body")
    kept = (
        found.join(small(stop), "site_id", "left")
        .where(F.col("stop_seq").isNull() | (F.col("seq") < F.col("stop_seq")))
        .drop("stop_seq")
        .join(answers, ["site_id", "externalId"], "left")
    )
    parts.append(workday_details(kept).select("site_id", "seq", "matchedProfiles", "detail"))
    if generic_pages is not None and generic_details is not None:
        able = wanted.join(small(stopped.withColumnRenamed("site_id", "id")), "id", "left_anti")
        found_pages = read_generic(generic_pages, generic_details, able, searches, max_pages, max_jobs)
        parts.append(cut(found_pages.select("site_id", "seq", "matchedProfiles", "detail"), "generic-jobs"))
    if generic_jobs is not None:
        ids = wanted.select(F.col("id").alias("site_id"))
        rows = generic_jobs.join(small(ids), "site_id")
        parts.append(rows.select("site_id", "seq", "matchedProfiles", "detail"))

    extracted = cut(normalise_postings(_stack(parts), wanted, now), "batch")
    batch = extracted if limit is None else cut(take_first(extracted, limit), "batch")
    merged, keys = merge_with_keys(store, batch, now, store_keys=store_keys)
    after = cut(merged, "merged")
    before = batch.limit(0) if store is None else store
    # Every listing of the other kinds has become a posting; Workday sites may have stopped early.
    listed = extracted.where(F.col("sourceType") != "workday").select("seq").unionByName(found.select("seq"))
    summary = run_summary(wanted, errors, verdicts, listed, extracted, before, batch, after)
    return RunResult(after, keys, batch, summary, profile_totals(batch), errors)


def in_site_order(payloads: DataFrame, sites: DataFrame) -> DataFrame:
    """Payloads of ``sites`` with ``seq`` dealt anew in the order of (site, arrival). The new
    numbers start at the smallest given one, so they stay above everything stored before."""
    return all_in_site_order([payloads], sites)[0]


def all_in_site_order(captures: list[DataFrame], sites: DataFrame) -> list[DataFrame]:
    """The frames with ``seq`` dealt anew in the order of (site, arrival) over all of them, so that payloads and
    pages of one run share one numbering. A number may stand in several rows of a frame: they are one capture.

    The new numbers take the room of the given ones, which must therefore be enough for all captures.
    """
    where = small(sites.select(F.col("id").alias("site_id"), F.col("seq").alias("site_seq")))
    thin = [f.select(F.lit(k).alias("kind"), "site_id", "seq").distinct() for k, f in enumerate(captures)]
    thin = _stack(thin).join(where, "site_id")
    numbered = cut(number_rows(thin, ["site_seq", "seq", "kind"], "place"), "capture-order")
    start, last, rows = numbered.agg(F.min("seq"), F.max("seq"), F.count(F.lit(1))).first()
    if rows and start + rows - 1 > last:
        raise ValueError("payloads and pages of a run must not use the same numbers: later runs would meet the new ones")
    new = numbered.select("kind", "site_id", "seq", (F.col("place") + F.lit(start or 0)).alias("ordered"))
    out = []
    for k, frame in enumerate(captures):
        mine = new.where(F.col("kind") == k).drop("kind")
        placed = frame.join(mine, ["site_id", "seq"]).drop("seq").withColumnRenamed("ordered", "seq")
        out.append(placed.select(*frame.columns))
    return out


def _stack(frames: list[DataFrame]) -> DataFrame:
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame)
    return stacked


def _without_generic_silence(errors: DataFrame, sites: DataFrame) -> DataFrame:
    """Generic sites are captured as pages, so having no payload is no failure for them."""
    generic = sites.where(F.col("adapter") == "generic").select(F.col("id").alias("site_id"))
    silent = F.col("message").startswith("No response captured")
    return errors.join(small(generic.withColumn("__generic", F.lit(True))), "site_id", "left").where(
        ~(F.coalesce("__generic", F.lit(False)) & silent)
    ).drop("__generic")
