"""Small tables with much work for each row are dealt out over the cores first."""

from pyspark.sql import functions as F

from postloom.operators.profiles import match_profiles, profile_totals
from postloom.operators.progress import crawl_frontier
from postloom.session import cut


def before_first_exchange(df):
    """The part of the plan below the lowest exchange of the rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.rindex("REPARTITION_BY_NUM"):] if "REPARTITION_BY_NUM" in plan else plan


def test_tags_are_worked_out_after_the_rows_are_dealt_out(spark):
    rows = cut(spark.range(50).select(F.concat(F.lit("QA lead "), F.col("id").cast("string")).alias("text")).coalesce(1), "texts")
    searches = spark.createDataFrame([(0, "lead 1", ["a", "b"]), (1, "qa", ["b", None]), (2, "none", ["c"])], "search_no int, keyword string, profileIds array<string>")
    totals = profile_totals(match_profiles(rows, "text", searches))
    assert "contains(" not in before_first_exchange(totals).lower()
    assert {r["profile"]: r["n"] for r in totals.collect()} == {"a": 11, "b": 50, None: 50}


def test_sources_are_dealt_out_before_they_become_searches(spark):
    sources = cut(spark.range(40).select(F.col("id").alias("seq"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source")).coalesce(1), "sources")
    roles = spark.createDataFrame([(0, "p", ["QA", "SDET"])], "seq long, profile string, keywords array<string>")
    progress = spark.createDataFrame([("s1::qa::united states", True, 3)], "key string, completed boolean, lastPage int")
    found = crawl_frontier(sources, roles, progress)
    assert "Generate" not in before_first_exchange(found)
    assert found.count() == 79
