"""Searches that go on page by page while their captured pages land.

The batch plan reads all pages of a search and then decides where it ended. Here pages arrive in
micro-batches, and each search has a state: the last page read, how many cards that page had, and whether
the search has ended or broke off. States and seen ids are :class:`BatchTable` tables, so a stream that is
killed is resumed from them, and a replayed batch finds what it found the first time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from postloom.operators.listings import drop_seen, page_verdicts
from postloom.schemas import PROGRESS
from postloom.session import cut
from postloom.streaming.tables import BUCKETS, BatchTable

STATE = StructType(
    [
        StructField("last_page", IntegerType()),
        StructField("n_cards", LongType()),
        StructField("ended", BooleanType()),
        StructField("broken_at", IntegerType()),
    ]
)


def pages_to_read(pages: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The pages of a micro-batch that a crawl would still read, with ``n_before``, the number of cards of the last page before them.

    Pages of searches that have ended, and pages already read, are left out. A search that broke off
    goes on once the page on which it broke off is there again.
    """
    known = state.select(*keys, "last_page", F.col("n_cards").alias("n_before"), "ended", "broken_at")
    joined = pages.join(known, keys, "left")
    again = pages.join(known, keys).where(F.col("page_no") == F.col("broken_at")).select(*keys).distinct()
    joined = joined.join(again.withColumn("__again", F.lit(True)), keys, "left")
    page = F.col("page_no")
    goes_on = F.coalesce(~F.col("ended"), F.lit(True)) & (page > F.coalesce("last_page", F.lit(-1)))
    whole = F.col("broken_at").isNull() | (F.coalesce("__again", F.lit(False)) & (page >= F.col("broken_at")))
    return joined.where(goes_on & whole).select(*pages.columns, "n_before")


def advance(
    state: DataFrame, pages: DataFrame, cards: DataFrame, seen: DataFrame, keys: list[str],
    id_col: str = "sourceJobId", endless: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(new state, pages read)`` after a micro-batch.

    ``pages`` has ``(keys, page_no, start_page, n_cards)`` and may have ``failed``; ``cards`` has
    ``(keys, page_no, id_col)``; ``seen`` has ``(keys, source_job_id)`` of earlier pages and runs. ``endless`` says
    which pages belong to endless lists, which follow the stall rule. Pages of a search must land in
    their order and each in one piece; how they are split over micro-batches makes no difference.
    """
    todo = cut(pages_to_read(pages, state, keys), "stream-pages")
    judged = page_verdicts(todo, cards.join(todo.select(*keys, "page_no"), [*keys, "page_no"], "left_semi"), keys, id_col, seen, endless)
    judged = cut(judged, "stream-verdicts")
    page, failed = F.col("page_no"), F.col("failed")
    ends = judged.groupBy(*keys).agg(
        F.min(F.when(F.col("before"), page - 1)).alias("ahead"),
        F.min(F.when(F.col("after"), page)).alias("at"),
        F.max(page).alias("newest"),
    )
    ends = ends.withColumn("stop", F.least("ahead", "at", "newest")).withColumn(
        "stopped", F.least("ahead", "at").isNotNull()
    )
    reached = judged.join(ends.select(*keys, "stop", "stopped"), keys)
    broken = reached.where(failed & (page <= F.col("stop"))).groupBy(*keys).agg(F.min(page).alias("broken_at"))
    reached = reached.join(broken, keys, "left")
    inside = (page <= F.col("stop")) & (F.col("broken_at").isNull() | (page < F.col("broken_at")))
    last = F.max(F.when(inside, F.struct(page.alias("page_no"), F.col("n_cards").cast("long").alias("n_cards"))))
    now = reached.groupBy(*keys).agg(
        last.alias("last"), F.first("stop").alias("stop"), F.first("stopped").alias("stopped"), F.first("broken_at").alias("broken_at")
    )
    old = state.select(*keys, F.col("last_page").alias("old_page"), F.col("n_cards").alias("old_cards"))
    new = now.join(old, keys, "left").select(
        *keys,
        F.coalesce("last.page_no", "old_page", F.when(F.col("broken_at").isNull(), F.col("stop")), F.lit(0)).cast("int").alias("last_page"),
        F.coalesce("last.n_cards", "old_cards").alias("n_cards"),
        (F.col("stopped") & F.col("broken_at").isNull()).alias("ended"),
        F.col("broken_at").cast("int").alias("broken_at"),
    )
    return cut(new, "stream-state"), reached.where(inside).select(*keys, "page_no", "n_cards")


@dataclass(frozen=True)
class Searches:
    """The tables that a stream of searches keeps under ``root``."""

    spark: SparkSession
    root: str
    keys: list[str]
    listing: StructType
    id_col: str = "sourceJobId"
    seed: DataFrame | None = None
    endless: Column | None = None
    buckets: int = BUCKETS

    def _key_fields(self) -> list[StructField]:
        return [self.listing[k] for k in self.keys]

    @property
    def states(self) -> BatchTable:
        extra = [StructField("lastUpdated", StringType())]
        schema = StructType([*self._key_fields(), *STATE.fields, *extra])
        return BatchTable(self.spark, f"{self.root}/states", schema, self.keys, latest=True, buckets=self.buckets)

    @property
    def seen(self) -> BatchTable:
        schema = StructType([*self._key_fields(), StructField("source_job_id", StringType())])
        # Bucketed by the search and the id: a search of any size is spread over all buckets.
        return BatchTable(self.spark, f"{self.root}/seen", schema, [*self.keys, "source_job_id"], buckets=self.buckets)

    @property
    def listings(self) -> BatchTable:
        return BatchTable(self.spark, f"{self.root}/listings", self.listing, self.keys, buckets=self.buckets)

    def known_ids(self, batch_id: int, touched: DataFrame) -> DataFrame:
        """``(keys, source_job_id)`` of earlier batches and of the seed, for the ids in ``touched``."""
        known = self.seen.before(batch_id, touched)
        if self.seed is not None:
            known = known.unionByName(self.seed.select(*self.keys, F.col("source_job_id").cast("string")))
        return known.join(touched, [*self.keys, "source_job_id"], "left_semi")

    def unseen(self, batch_id: int, cards: DataFrame, order: list[str]) -> DataFrame:
        """Cards of a batch whose id no earlier batch and not the seed has; in the batch the first wins.
        The ids are added to the table."""
        ids = cards.where(F.coalesce(F.col(self.id_col), F.lit("")) != "")
        ids = cut(ids.select(*self.keys, F.col(self.id_col).alias("source_job_id")).distinct(), "stream-ids")
        known = cut(self.known_ids(batch_id, ids), "stream-known")
        self.seen.compact(batch_id)
        self.seen.write(ids.join(known, [*self.keys, "source_job_id"], "left_anti"), batch_id)
        return drop_seen(cards, known, self.keys, self.id_col, order)

    def read_batch(self, batch_id: int, pages: DataFrame, cards: DataFrame, order: list[str], now: str) -> DataFrame:
        """One micro-batch: searches move on, ids become seen, new listings are kept and returned."""
        touched = pages.select(*self.keys).distinct()
        state = cut(self.states.before(batch_id, touched).drop("lastUpdated"), "stream-before")
        ids = cards.where(F.coalesce(F.col(self.id_col), F.lit("")) != "")
        ids = ids.select(*self.keys, F.col(self.id_col).alias("source_job_id")).distinct()
        known = cut(self.known_ids(batch_id, ids), "stream-known")
        new, read = advance(state, pages, cards, known, self.keys, self.id_col, self.endless)
        found = cards.join(cut(read, "stream-read").select(*self.keys, "page_no"), [*self.keys, "page_no"], "left_semi")
        fresh = cut(self.unseen(batch_id, found, order), "stream-fresh")
        self.listings.compact(batch_id)
        self.listings.write(fresh, batch_id)
        self.states.compact(batch_id)
        self.states.write(new.withColumn("lastUpdated", F.lit(now)), batch_id)
        return fresh

    def progress(self, names: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The searches as progress rows: a search is completed when a stop rule has ended it. ``names``
        adds ``key, source, keyword, location``."""
        rows = self.states.all().select(
            *self.keys, F.col("last_page").alias("lastPage"), F.col("ended").alias("completed"), "lastUpdated"
        )
        rows = rows if names is None else names(rows)
        return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in PROGRESS.fieldNames()])


def stream_searches(
    landed: DataFrame, searches: Searches, checkpoint: str, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    order: list[str], now_of: Callable[[int], str], trigger: dict | None = None,
) -> StreamingQuery:
    """Keep ``searches`` up to date with pages as they land. ``split`` makes ``(pages, cards)`` of a micro-batch;
    ``now_of`` must give a replayed batch the time it had before."""

    def step(batch: DataFrame, batch_id: int) -> None:
        pages, cards = split(cut(batch, "stream-batch"))
        searches.read_batch(batch_id, pages, cards, order, now_of(batch_id))

    writer = landed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_unseen(
    listings: DataFrame, searches: Searches, checkpoint: str, order: list[str], trigger: dict | None = None
) -> StreamingQuery:
    """Keep the first listing of each (search, id) that was not seen before, over all batches and the seed."""

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = cut(searches.unseen(batch_id, cut(batch, "stream-batch"), order), "stream-fresh")
        searches.listings.compact(batch_id)
        searches.listings.write(fresh, batch_id)

    writer = listings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
