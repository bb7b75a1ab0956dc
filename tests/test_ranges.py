"""Ranges of a store with long postings."""

from pyspark.sql import functions as F

from postloom.sources.store import RANGED_POSTING, publish_ranges, read_published


def test_long_postings_of_one_range_are_written_by_several_tasks(spark, folder):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "256k")
    try:
        known = {"seq": F.col("id"), "descriptionText": F.concat_ws("", *[F.sha2(F.concat_ws(" ", "id", F.lit(k)), 512) for k in range(4)])}
        rows = spark.range(0, 8_000, 1, 8).select(
            *[known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in RANGED_POSTING.fields]
        )
        publish_ranges(rows, folder, 1, [0, 7_000])
    finally:
        spark.conf.set(name, before)
    files = read_published(spark, folder).select(F.regexp_extract(F.input_file_name(), r"range=(\d+)", 1).alias("range"), F.input_file_name().alias("file"))
    found = {r["range"]: (r["files"], r["rows"]) for r in files.groupBy("range").agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("rows")).collect()}
    assert found["0"][0] > 1 and (found["0"][1], found["1"][1]) == (7_000, 1_000)
