"""Listing files as a stream, and a postings store kept up to date by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from postloom.operators.merge import (
    assign_slots,
    merge_slots,
    merge_with_keys,
    merged_keys,
    stack_batches,
    tier_keys,
)
from postloom.schemas import STORED_LISTING, STORED_POSTING
from postloom.session import cut
from postloom.sources.store import (
    KEY_COLUMNS,
    ROWS_PER_RANGE,
    in_file_order,
    load_ranges,
    publish_ranges,
    range_index,
    read_published,
    read_ranges,
    split_points,
)
from postloom.streaming.tables import BatchTable


ARRIVAL = ["__file", "__start"]


def listing_stream(
    spark: SparkSession, path: str, max_files: int | None = None, arrival: bool = False
) -> DataFrame:
    """New listing files as they land. Unreadable lines keep only ``_corrupt``. With ``arrival`` a row also carries where
    it stands, as :func:`number_arrivals` needs it."""
    schema = StructType([*STORED_LISTING.fields, StructField("_corrupt", StringType())])
    reader = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", "_corrupt")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.json(path)
    if not arrival:
        return rows
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
    )


def arrival_counter(spark: SparkSession, root: str) -> BatchTable:
    """The next free arrival number, as of every micro-batch."""
    return BatchTable(spark, root, StructType.fromDDL("name string, next long"), ["name"], latest=True, buckets=1)


def number_arrivals(batch: DataFrame, batch_id: int, counter: BatchTable) -> DataFrame:
    """A micro-batch of :func:`listing_stream` with ``seq`` on every row.

    Lines that carry a number keep it. The others are numbered in the order of the names of their
    files and of the lines, above every number of earlier batches and of this one. The counter is
    kept per batch, so a replayed batch gets the same numbers.
    """
    placed = cut(batch.withColumn("__n", F.monotonically_increasing_id()), "arrivals")
    rows, own = placed.agg(F.count(F.lit(1)), F.max("seq")).first()
    before = counter.before(batch_id).agg(F.max("next")).first()[0] or 0
    first = before if own is None else max(before, own + 1)
    one = batch.sparkSession.range(1).select(F.lit("seq").alias("name"), F.lit(first + rows).alias("next"))
    counter.compact(batch_id)
    counter.write(one, batch_id)
    numbered = in_file_order(placed, ARRIVAL, "__place")
    return numbered.withColumn("seq", F.coalesce("seq", F.col("__place") + F.lit(first))).drop("__n", "__place", *ARRIVAL)


def split_stream(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = lines.where(F.col("_corrupt").isNull()).drop("_corrupt")
    return good, lines.where(F.col("_corrupt").isNotNull()).select(F.col("_corrupt").alias("line"))


def stream_drop_seen(
    listings: DataFrame, keys: list[str], id_col: str = "sourceJobId", event_time: str | None = None
) -> DataFrame:
    """First row per (keys, id); rows without an id pass.

    Without ``event_time`` every id is remembered for good. With it, ids are remembered within
    the watermark set on that column.
    """
    has_id = F.coalesce(F.col(id_col), F.lit("")) != ""
    with_id = listings.where(has_id)
    if event_time:
        unique = with_id.dropDuplicatesWithinWatermark([*keys, id_col])
    else:
        unique = with_id.dropDuplicates([*keys, id_col])
    return unique.union(listings.where(~has_id))


def merge_version(
    batch: DataFrame,
    root: str,
    version: int,
    now: str,
    blocks: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> int:
    """Write version ``version`` from version ``version - 1`` and the batch; returns how many
    ranges of the store were written.

    Matching reads the keys of the whole store, which are narrow. Only ranges that hold a
    replaced posting are then read and written again; new postings fill up the last range or
    start new ones. The result depends only on the two inputs, so running it again after a
    failure writes the same version and never merges a batch twice.
    """
    spark = batch.sparkSession
    prior = read_ranges(spark, root, version - 1) if version > 1 else []
    batch_keys = cut(tier_keys(batch), "batch-keys")
    if prior is None:  # a store published whole: from now on it has ranges
        old = read_published(spark, root, version - 1)
        rows, keys = merge_with_keys(old, batch, now, blocks=blocks)
        rows = cut(rows, "merged")
        bounds = split_points(rows.select("seq"), rows_per_range)
        publish_ranges(rows.join(keys, "seq"), root, version, bounds)
        return len(bounds)
    store_keys = load_ranges(spark, root, prior).select("seq", *KEY_COLUMNS) if prior else None
    slots = cut(assign_slots(store_keys, batch_keys, blocks), "slots")
    starts = [r["lo"] for r in prior]
    seqs = batch_keys.select("seq")
    first_new = seqs.agg(F.min("seq")).first()[0]
    old = slots.where(F.col("slot") < F.lit(first_new)) if first_new is not None else slots
    hit = {r["i"] for r in old.select(range_index(F.col("slot"), starts).alias("i")).distinct().collect()} if prior else set()
    fresh = split_points(seqs, rows_per_range)
    if prior and prior[-1]["rows"] < rows_per_range:
        hit.add(len(prior) - 1)  # the last range is not full yet: the first new rows go there
        fresh = fresh[1:]
    touched = [r for i, r in enumerate(prior) if i in hit]
    part = cut(load_ranges(spark, root, touched), "touched") if touched else None
    store = None if part is None else part.select(*STORED_POSTING.fieldNames())
    rows = merge_slots(stack_batches(store, batch), slots, now)
    keys = batch_keys if part is None else part.select("seq", *KEY_COLUMNS).unionByName(batch_keys)
    whole = rows.join(merged_keys(keys, slots), "seq")
    bounds = [*[r["lo"] for r in touched], *fresh]
    publish_ranges(whole, root, version, bounds, [r for i, r in enumerate(prior) if i not in hit])
    return len(bounds)


def stream_merge(
    listings: DataFrame,
    root: str,
    checkpoint: str,
    resolve_batch: Callable[[DataFrame], DataFrame],
    now_of: Callable[[int], str],
    trigger: dict | None = None,
) -> StreamingQuery:
    """Resolve each micro-batch and merge it into the store at ``root``.

    Version ``batch id + 1`` is always made from version ``batch id``. ``now_of`` gives the run
    time of a batch and must give the same answer when the batch is replayed.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        postings = cut(resolve_batch(batch), "stream-batch")
        merge_version(postings, root, batch_id + 1, now_of(batch_id))

    writer = listings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()

