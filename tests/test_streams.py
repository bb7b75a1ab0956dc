"""Streams with durable state: any split into micro-batches, replays and kills give the batch plan's result."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from postloom.operators.listings import drop_seen, dry_stop, stall_stop
from postloom.schemas import LONG, shape
from postloom.streaming.intake import arrival_counter, listing_stream, number_arrivals
from postloom.streaming.searches import Searches, stream_searches, stream_unseen
from postloom.streaming.tables import BatchTable

CARD = shape(
    "key page_no pos sourceJobId failed n", page_no=IntegerType(), pos=LONG, failed=BooleanType(), n=IntegerType()
)
SEED = "key string, source_job_id string"


def crawl(seed):
    """Pages of a few searches in the order they land: (key, page_no, ids)."""
    draw = random.Random(seed)
    pages = []
    for key in "abcdef":
        for page in range(1, draw.choice((1, 3, 8))):
            n = draw.choice((0, 2, 2, 3))
            pages.append((key, page, [draw.choice((None, "", *"123456789")) for _ in range(n)]))
    order = sorted(range(len(pages)), key=lambda i: (pages[i][1] + draw.random() * 0.5, pages[i][0]))
    return [pages[i] for i in order]


def rows_of(pages):
    """One row for each card; a page without cards is one row with ``n`` 0."""
    out = []
    for k, p, ids in pages:
        if not ids:
            out.append((k, p, p * 100, None, False, 0))
        out += [(k, p, p * 100 + j, i, False, len(ids)) for j, i in enumerate(ids)]
    return out


def split(batch):
    pages = batch.groupBy("key", "page_no").agg(F.max("n").cast("long").alias("n_cards"), F.bool_or("failed").alias("failed"))
    return pages.withColumn("start_page", F.lit(1)), batch.where("n > 0")


def land(spark, rows, folder, n):
    spark.createDataFrame(rows, CARD).coalesce(1).write.mode("append").json(f"{folder}/in", ignoreNullFields=False)


def stream(spark, folder):
    return spark.readStream.schema(CARD).json(f"{folder}/in")


@pytest.mark.parametrize(("seed", "endless"), [(1, False), (2, True)])
def test_stops_do_not_depend_on_the_split(spark, folder, seed, endless):
    draw = random.Random(seed)
    landed = crawl(seed)
    seed_ids = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], SEED)
    whole = spark.createDataFrame(rows_of(landed), CARD)
    pages, cards = split(whole)
    rule = stall_stop if endless else dry_stop
    want = {r["key"]: r["last_page"] for r in rule(pages, cards, ["key"], seen=seed_ids).collect()}
    kept = cards.join(spark.createDataFrame(list(want.items()), "key string, last int"), "key").where("page_no <= last").drop("last")
    new = drop_seen(kept, seed_ids, ["key"], "sourceJobId", ["page_no", "pos"])
    searches = Searches(spark, f"{folder}/state", ["key"], CARD, buckets=4, seed=seed_ids, endless=F.lit(endless))
    start = 0
    while start < len(landed):
        size = draw.choice((3, 5, 9))
        land(spark, rows_of(landed[start : start + size]), folder, start)
        start += size
        run = stream_searches(stream(spark, folder), searches, f"{folder}/check", split, ["page_no", "pos"], lambda b: f"t{b}")
        run.awaitTermination()
    got = {r["key"]: r["lastPage"] for r in searches.progress().collect()}
    assert got == want
    assert sorted(map(repr, searches.listings.all().collect())) == sorted(map(repr, new.collect()))


def test_a_killed_batch_is_replayed(spark, folder):
    rows = rows_of([("a", 1, ["1", "2"]), ("b", 1, ["1"])])
    more = rows_of([("a", 2, ["2", "3"]), ("b", 2, ["1"]), ("c", 1, ["9"])])
    seed_ids = spark.createDataFrame([("c", "9")], SEED)
    searches = Searches(spark, f"{folder}/state", ["key"], CARD, buckets=4, seed=seed_ids)

    def run(split_):
        query = stream_searches(stream(spark, folder), searches, f"{folder}/check", split_, ["page_no", "pos"], lambda b: f"t{b}")
        query.awaitTermination()

    def tables():
        frames = (searches.states.all(), searches.seen.all(), searches.listings.all())
        return [sorted(map(repr, f.collect())) for f in frames]

    land(spark, rows, folder, 0)
    run(split)
    land(spark, more, folder, 1)
    write = BatchTable.write
    killed = []

    def dies(self, frame, batch_id):
        write(self, frame, batch_id)
        if self.root.endswith("listings"):
            killed.append(batch_id)
            raise RuntimeError("killed after the listings were written")

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(BatchTable, "write", dies)
        with pytest.raises(Exception, match="killed"):
            run(split)
    assert killed == [1]
    run(split)  # batch 1 again
    first = tables()
    assert {r["key"]: (r["lastPage"], r["completed"], r["lastUpdated"]) for r in searches.progress().collect()} == {
        "a": (2, False, "t1"), "b": (2, True, "t1"), "c": (1, False, "t1"),
    }
    assert sorted((r["key"], r["sourceJobId"]) for r in searches.listings.all().collect()) == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1")]
    searches.read_batch(1, *split(spark.createDataFrame(more, CARD)), ["page_no", "pos"], "t1")
    assert tables() == first


def test_a_broken_search_goes_on_from_its_page(spark, folder):
    searches = Searches(spark, f"{folder}/state", ["key"], CARD, buckets=4)

    def batch(n, *pages):
        rows = [(k, p, p * 100, i, failed, 1) for k, p, i, failed in pages]
        searches.read_batch(n, *split(spark.createDataFrame(rows, CARD)), ["page_no", "pos"], f"t{n}")
        return [(r["last_page"], r["ended"], r["broken_at"]) for r in searches.states.all().collect()]

    assert batch(0, ("a", 1, "1", False), ("a", 2, "2", True), ("a", 3, "3", False)) == [(1, False, 2)]
    assert batch(1, ("a", 4, "4", False)) == [(1, False, 2)]  # pages after the break are not read
    assert batch(2, ("a", 2, "2", False), ("a", 3, "3", False)) == [(3, False, None)]
    assert batch(3, ("a", 4, "3", False), ("a", 5, "5", False)) == [(4, True, None)]
    assert batch(4, ("a", 6, "6", False)) == [(4, True, None)]
    assert sorted(r["sourceJobId"] for r in searches.listings.all().collect()) == ["1", "2", "3"]


def test_unseen_listings_over_batches(spark, folder):
    seed_ids = spark.createDataFrame([("a", "9")], SEED)
    searches = Searches(spark, f"{folder}/state", ["key"], CARD, buckets=4, seed=seed_ids)
    for n, rows in enumerate(([("a", 1, ["1", "9", None, "1"])], [("a", 2, ["1", "2", ""]), ("b", 1, ["9"])], [("b", 2, ["9", "1"])])):
        land(spark, rows_of(rows), folder, n)
        stream_unseen(stream(spark, folder), searches, f"{folder}/check", ["page_no", "pos"]).awaitTermination()
    got = sorted((r["key"], r["pos"], r["sourceJobId"]) for r in searches.listings.all().collect())
    assert got == [("a", 100, "1"), ("a", 102, None), ("a", 201, "2"), ("a", 202, ""), ("b", 100, "9"), ("b", 201, "1")]
    assert searches.seen.all().count() == 4  # one row for each new id, whatever the number of cards


def test_batch_table_is_compacted_and_pruned(spark, folder):
    table = BatchTable(spark, f"{folder}/t", StructType.fromDDL("k string, v int"), ["k"], latest=True, buckets=8, compact_every=3)
    rows = {}
    for b in range(8):
        new = {f"k{b % 4}": b, f"k{(b + 1) % 4}": b}
        before = {r["k"]: r["v"] for r in table.before(b).collect()}
        assert before == rows
        table.compact(b)
        assert {r["k"]: r["v"] for r in table.before(b).collect()} == rows
        for _ in range(2):  # a replay
            table.write(spark.createDataFrame(list(new.items()), "k string, v int"), b)
        rows |= new
    assert {r["k"]: r["v"] for r in table.all().collect()} == rows
    assert len(table._folders("batch")) <= 3 and len(table._folders("upto")) == 1
    one = table.before(99, spark.createDataFrame([("k1",)], "k string"))
    assert {r["k"]: r["v"] for r in one.collect()}["k1"] == rows["k1"]
    scanned = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scanned and "__bucket" in scanned


def test_lines_without_a_number_get_one(spark, folder):
    counter = arrival_counter(spark, f"{folder}/counter")
    given = []

    def land_lines(name, *lines):
        import os

        os.makedirs(f"{folder}/in", exist_ok=True)
        with open(f"{folder}/in/{name}.json", "w") as file:
            file.write("\n".join(lines) + "\n")

    def step(batch, batch_id):
        rows = number_arrivals(batch, batch_id, counter)
        again = number_arrivals(batch, batch_id, counter)
        assert sorted(map(repr, rows.collect())) == sorted(map(repr, again.collect()))
        given.append(sorted((r["seq"], r["title"]) for r in rows.collect()))

    def run():
        rows = listing_stream(spark, f"{folder}/in", arrival=True)
        rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()

    land_lines("a", '{"title": "one"}', '{"title": "two"}', "broken", '{"title": "three"}')
    run()
    land_lines("b", '{"title": "four"}', '{"title": "five", "seq": 50}', '{"title": "six"}')
    run()
    land_lines("c", '{"title": "seven"}')
    run()
    assert [t for _, t in given[0]] == ["one", "two", None, "three"] and given[0][0][0] == 0
    assert given[1] == [(50, "five"), (51, "four"), (53, "six")] and given[2] == [(54, "seven")]
