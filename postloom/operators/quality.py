"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import with_challenge
from postloom.schemas import ATS_KINDS, VERIFICATION_STATUSES

EMPTY = "String must contain at least 1 character(s)"


def _one_of(allowed: list[str], got: Column) -> Column:
    names = " | ".join(f"'{a}'" for a in allowed)
    return F.concat(F.lit(f"Invalid enum value. Expected {names}, received '"), got, F.lit("'"))


def registry_violations(registry: DataFrame) -> DataFrame:
    """``(seq, field, message)``: one row per broken rule of a registry entry."""

    def rule(field: str, broken: Column, message: Column | str) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.when(broken, F.struct(F.lit(field).alias("field"), text.alias("message")))

    def required(field: str) -> Column:
        return rule(field, F.col(field).isNull(), "Expected string, received null")

    rules = [
        required("company"),
        rule("company", F.col("company") == "", EMPTY),
        rule("fortuneRank", F.col("fortuneRank") <= 0, "Number must be greater than 0"),
        required("corporateDomain"),
        rule("corporateDomain", F.col("corporateDomain") == "", EMPTY),
        required("careersUrl"),
        rule("careersUrl", ~F.col("careersUrl").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^\s/?#]+|[^/\s])"), "Invalid url"),
        required("atsType"),
        rule("atsType", ~F.col("atsType").isin(ATS_KINDS), _one_of(ATS_KINDS, F.col("atsType"))),
        rule("atsTenantOrBoardId", F.col("atsTenantOrBoardId") == "", EMPTY),
        required("verificationStatus"),
        rule(
            "verificationStatus",
            ~F.col("verificationStatus").isin(VERIFICATION_STATUSES),
            _one_of(VERIFICATION_STATUSES, F.col("verificationStatus")),
        ),
    ]
    broken = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return registry.select("seq", F.explode(broken).alias("r")).select("seq", "r.field", "r.message")


def challenge_report(pages: DataFrame, source_col: str = "source") -> DataFrame:
    """``(source, reason, n)`` over pages with ``title`` and ``html``."""
    return (
        with_challenge(pages, "title", "html", "reason")
        .select(F.col(source_col).alias("source"), "reason")
        .where(F.col("reason").isNotNull())
        .groupBy("source", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )
