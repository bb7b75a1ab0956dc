"""Run outcome: per-source errors and the one-row summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.sources.payloads import site_identity


def site_errors(sites: DataFrame, triage: DataFrame) -> DataFrame:
    """``(site_id, site_seq, fail_seq, list_failed, message)``: the first failure of each site.

    A configuration error comes before any payload. ``fail_seq`` is the payload at which the
    site stopped (null for configuration errors); one failing site never affects another.
    """
    ready = site_identity(sites).select(
        F.col("id").alias("site_id"), F.col("seq").alias("site_seq"), "config_error"
    )
    failures = triage.where(F.col("verdict") != "ok")
    listing = F.col("source_kind") != "workday_detail"
    first = failures.groupBy("site_id").agg(
        F.min(F.struct((~listing).alias("late"), "seq", "error")).alias("f")
    )
    answered = triage.where(listing).select("site_id").distinct().withColumn("answered", F.lit(True))
    joined = ready.join(first, "site_id", "left").join(answered, "site_id", "left")
    silent = F.when(
        F.col("answered").isNull(), F.concat(F.lit("No response captured for site "), F.col("site_id"))
    )
    message = F.coalesce("config_error", "f.error", silent)
    return joined.select(
        "site_id",
        "site_seq",
        F.when(F.col("config_error").isNull(), F.col("f.seq")).alias("fail_seq"),
        (
            F.col("config_error").isNotNull()
            | F.col("answered").isNull()
            | F.coalesce(~F.col("f.late"), F.lit(False))
        ).alias("list_failed"),
        message.alias("message"),
    ).where(F.col("message").isNotNull())


def run_summary(
    sites: DataFrame,
    errors: DataFrame,
    triage: DataFrame,
    listings: DataFrame,
    details: DataFrame,
    before: DataFrame,
    batch: DataFrame,
    after: DataFrame,
) -> DataFrame:
    """One row of counts. Each input is counted once, by its own aggregate."""

    def n(df: DataFrame):
        return df.agg(F.count(F.lit(1))).scalar()

    attempted, failed = n(sites), n(errors)
    listed = errors.agg(
        F.coalesce(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("site_seq", F.col("site_id").alias("site"), "message"))
                ),
                lambda e: F.struct(e["site"].alias("site"), e["message"].alias("message")),
            ),
            F.array().cast("array<struct<site:string,message:string>>"),
        )
    ).scalar()
    spark = sites.sparkSession
    return spark.range(1).select(
        attempted.alias("sitesAttempted"),
        (attempted - failed).alias("sitesSucceeded"),
        failed.alias("sitesFailed"),
        n(listings).alias("listingsDiscovered"),
        n(details).alias("jdsExtracted"),
        duplicates_removed(n(before), n(batch), n(after)).alias("duplicatesRemoved"),
        triage.agg(F.count_if(F.col("verdict") == "challenge")).scalar().alias("verificationPauses"),
        n(after).alias("jobsWritten"),
        listed.alias("errors"),
    )


def duplicates_removed(before, batch, after):
    """Rows that did not become rows of their own."""
    return before + batch - after
