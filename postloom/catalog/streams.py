"""Streams: seen ids, stop rules, progress, arrival numbers and a store kept by micro-batches."""

import uuid

from pyspark.sql import functions as F

from postloom.catalog.base import query, table
from postloom.catalog.crawling import EVENTS, PAGES, SEEN, events, seen_ids
from postloom.schemas import LONG, STORED_POSTING, INT, shape
from postloom.session import cut, scratch_root
from postloom.sources.store import append_listings, read_published
from postloom.streaming.intake import arrival_counter, listing_stream, number_arrivals, stream_merge
from postloom.streaming.searches import Searches, stream_searches, stream_unseen

CARD = shape("key page_no pos sourceJobId", page_no=INT, pos=LONG)
BATCHES, BUCKETS = 3, 16
ORDER = ["page_no", "pos"]


def _folder(spark):
    return f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"


def _micro_batch(cards):
    """Which of the micro-batches a page lands in: earlier pages land earlier."""
    last = cards.agg(F.max("page_no").alias("last_no"))
    number = F.floor(F.col("page_no") * BATCHES / (F.col("last_no") + 1)).cast("int")
    return cards.join(F.broadcast(last), how="cross").withColumn("part", number).drop("last_no")


def _split(batch):
    pages = batch.groupBy("key", "page_no").agg(F.count(F.lit(1)).alias("n_cards"))
    return pages.withColumn("start_page", F.lit(1)), batch


def _land(spark, sf_dir, base, run):
    """Cards of the events, landed in parts; ``run`` is called after each and reads what is new."""
    cards = cut(_micro_batch(events(spark, sf_dir)), "landing")
    for part in range(BATCHES):
        rows = cards.where(F.col("part") == part).select(*CARD.fieldNames())
        rows.write.mode("append").json(f"{base}/in", ignoreNullFields=False)
        run(spark.readStream.schema(CARD).json(f"{base}/in")).awaitTermination()
    return cards


@query(f"""with {EVENTS}, {SEEN}
    select key, page_no, pos, id as "sourceJobId" from cards where coalesce(id, '') = ''
    union all select key, page_no, pos, id from (select *, row_number() over (partition by key, id order by page_no, pos) as n
      from cards where coalesce(id, '') <> '') where n = 1 and (key, id) not in (select (key, id) from seen)""")
def stream_unseen_listings(spark, sf_dir):
    """Unseen listings over three micro-batches, with the ids of earlier runs as the first state."""
    base = _folder(spark)
    searches = Searches(spark, f"{base}/state", ["key"], CARD, seed=seen_ids(spark, sf_dir), buckets=BUCKETS)
    _land(spark, sf_dir, base, lambda rows: stream_unseen(rows, searches, f"{base}/check", ORDER))
    return searches.listings.all()


def _searches(spark, sf_dir, endless):
    base = _folder(spark)
    searches = Searches(
        spark, f"{base}/state", ["key"], CARD, seed=seen_ids(spark, sf_dir), endless=F.lit(endless), buckets=BUCKETS
    )
    cards = _land(
        spark, sf_dir, base, lambda rows: stream_searches(rows, searches, f"{base}/check", _split, ORDER, lambda b: f"t{b}")
    )
    return searches, cards


@query(PAGES + """ select key, coalesce(min(case when new_ids = 0 and page_no > 1 then page_no end), max(page_no)) as last_page
    from counted group by key""")
def stream_dry_pages(spark, sf_dir):
    """The dry rule, page by page while they land."""
    return _searches(spark, sf_dir, False)[0].states.all().select("key", "last_page")


@query(PAGES + """ select key, least(coalesce(min(case when n_cards = before then page_no - 1 end), max(page_no)),
    coalesce(min(case when new_ids = 0 then page_no end), max(page_no))) as last_page from counted group by key""")
def stream_stalled_pages(spark, sf_dir):
    """The stall rule of endless lists, page by page while they land."""
    return _searches(spark, sf_dir, True)[0].states.all().select("key", "last_page")


@query(PAGES + f""", ends as (select key, min(case when new_ids = 0 and page_no > 1 then page_no end) as dry, max(page_no) as newest
      from counted group by key), whole as (select max(page_no) as last_no from cards),
    ids as (select c.key, count(distinct c.id) as ids from cards c join ends e on e.key = c.key and c.page_no <= coalesce(e.dry, e.newest)
      where coalesce(c.id, '') <> '' and (c.key, c.id) not in (select (key, id) from seen) group by all)
    select e.key, coalesce(dry, newest) as "lastPage", dry is not null as completed,
      't' || (coalesce(dry, newest) * {BATCHES} // (last_no + 1)) as "lastUpdated", coalesce(ids, 0) as new_ids
    from ends e cross join whole left join ids i on i.key = e.key""")
def stream_progress(spark, sf_dir):
    """Progress and seen ids as tables of the stream. The last micro-batch runs twice and changes nothing."""
    searches, cards = _searches(spark, sf_dir, False)
    again = cards.where(F.col("part") == BATCHES - 1).select(*CARD.fieldNames())
    searches.read_batch(BATCHES - 1, *_split(again), ORDER, f"t{BATCHES - 1}")
    ids = searches.seen.all().groupBy("key").agg(F.count(F.lit(1)).alias("new_ids"))
    rows = searches.progress().select("key", "lastPage", "completed", "lastUpdated").join(ids, "key", "left")
    return rows.fillna(0, ["new_ids"])


@query("""select event_type as source, row_number() over (order by event_id) - 1 as seq, event_id from events""")
def stream_numbers(spark, sf_dir):
    """Listings that land without a number, in two micro-batches, get growing numbers in the order of their lines."""
    base = _folder(spark)
    counter = arrival_counter(spark, f"{base}/counter")
    lines = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("title"), "event_id"
    )
    half = lines.agg(F.expr("(min(event_id) + max(event_id)) div 2")).first()[0]

    def step(batch, batch_id):
        rows = number_arrivals(batch, batch_id, counter)
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        ranged = lines.where(part).repartitionByRange("event_id").sortWithinPartitions("event_id").drop("event_id")
        append_listings(ranged, f"{base}/in")
        rows = listing_stream(spark, f"{base}/in", arrival=True)
        rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select("source", "seq", F.col("title").cast("long").alias("event_id"))


@query("""with rows as (select event_id as seq, 'https://x.com/' || (user_id * 31 % 997) as url, 'L' || event_id as title,
      case when event_id <= (select (min(event_id) + max(event_id)) // 2 from events) then 't0' else 't1' end as run from events)
    select min(seq) as seq, arg_min('e' || seq, seq) as id, url as "canonicalUrl", arg_max(title, seq) as title,
      arg_min(run, seq) as "discoveredAt", arg_max(run, seq) as "lastSeenAt" from rows group by url""")
def stream_store(spark, sf_dir):
    """A store kept by two micro-batches of postings; the second is merged into what the first has written."""
    base = _folder(spark)
    known = {
        "seq": F.col("event_id"), "id": F.concat(F.lit("e"), F.col("event_id").cast("string")), "source": F.lit("s"),
        "title": F.concat(F.lit("L"), F.col("event_id").cast("string")),
        "canonicalUrl": F.concat(F.lit("https://x.com/"), (F.col("user_id") * 31 % 997).cast("string")),
        "matchedProfiles": F.array(F.lit("p")), "discoveredFrom": F.array(F.lit("s")),
    }
    rows = table(spark, sf_dir, "events").select(
        *[known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in STORED_POSTING.fields]
    )
    half = rows.agg(F.expr("(min(seq) + max(seq)) div 2")).first()[0]
    for part in (F.col("seq") <= half, F.col("seq") > half):
        rows.where(part).write.mode("append").json(f"{base}/in", ignoreNullFields=False)
        landed = spark.readStream.schema(STORED_POSTING).json(f"{base}/in")
        stream_merge(landed, f"{base}/store", f"{base}/check", lambda df: df, lambda b: f"t{b}").awaitTermination()
    return read_published(spark, f"{base}/store").select("seq", "id", "canonicalUrl", "title", "discoveredAt", "lastSeenAt")
