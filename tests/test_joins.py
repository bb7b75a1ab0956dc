"""Tables that Parquet packs into little space are not sent through the driver."""

from pyspark.sql import functions as F

from postloom.operators import merge
from postloom.operators.listings import up_to_last_page
from postloom.operators.ordered import small
from postloom.session import cut


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [name for name in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin") if name in plan]


def packed(spark, rows):
    return cut(spark.range(rows).select(F.lit("a long key that repeats").alias("key"), F.col("id").alias("page_no")), "packed")


def test_a_table_over_the_limit_is_shuffled(spark):
    pages = packed(spark, 2_000)
    assert joins(pages.join(small(pages.select("page_no"), 1_000), "page_no")) == ["SortMergeJoin"]
    assert joins(pages.join(small(pages.select("page_no"), 2_000), "page_no")) == ["BroadcastHashJoin"]


def test_stop_rules_do_not_broadcast_searches(spark):
    pages = packed(spark, 2_000)
    stops = pages.groupBy("key").agg(F.max("page_no").alias("last_page"))
    found = up_to_last_page(pages, stops, ["key"])
    assert joins(found) == ["SortMergeJoin"] and found.count() == 2_000


def test_merge_does_not_broadcast_fates_over_the_limit(spark, monkeypatch):
    monkeypatch.setattr(merge, "BROADCAST_FATES", 100)
    text = F.col("id").cast("string")
    rows = spark.range(2_000).select(
        F.col("id").alias("seq"), text.alias("id"), F.lit("s").alias("source"), F.lit("t0").alias("discoveredAt"), F.lit("t0").alias("lastSeenAt"),
        F.array(F.lit("s")).alias("discoveredFrom"), F.array(F.lit("p")).alias("matchedProfiles"), F.lit(False).alias("is_store"),
    )
    slots = spark.range(1_000, 2_000).select(F.col("id").alias("seq"), (F.col("id") - 1_000).alias("slot"))
    merged = merge.merge_slots(cut(rows, "rows"), cut(slots, "slots"), "t1")
    assert joins(merged) == ["SortMergeJoin"]
    assert merged.count() == 1_000 and merged.where("lastSeenAt = 't1' and id = cast(seq as string)").count() == 1_000
