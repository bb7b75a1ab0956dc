"""Files, versions and streams."""

import json
import os

from postloom.operators.merge import merge_postings
from postloom.schemas import LISTING, PROGRESS, SEEN_IDS, STORED_LISTING, STORED_POSTING
from postloom.sources.store import (
    append_listings, current_version, drop_old_versions, publish_postings, read_keys, read_listings, read_postings, read_progress,
    read_published, read_ranges, read_registry, write_progress,
)
from postloom.streaming.intake import listing_stream, merge_version, split_stream, stream_drop_seen, stream_merge


def posting(seq, url, **over):
    row = dict(seq=seq, id=f"p{seq}", source="s", company="C", title=f"Role {seq}", canonicalUrl=url, descriptionText="", matchedProfiles=["a"], discoveredFrom=["s"], rawMetadata='{"a":1}')
    row.update(over)
    return tuple(row.get(f) for f in STORED_POSTING.fieldNames())


def test_missing_file_is_empty(spark, folder):
    good, bad = read_postings(spark, f"{folder}/none.jsonl")
    assert good.count() == 0 and bad.count() == 0 and good.columns[0] == "seq"


def test_bad_lines_are_set_aside(spark, folder):
    path = f"{folder}/jobs.jsonl"
    lines = ['{"id":"a","rawMetadata":{"x":[1]}}', "", "  ", "{broken", "123", '{"id":"b","location":null}', '{"id":"c","matchedProfiles":["q"]}']
    with open(path, "w") as out:
        out.write("\n".join(lines) + "\n")
    good, bad = read_postings(spark, path, start=10)
    rows = good.orderBy("seq").collect()
    assert [r.id for r in rows] == ["a", "b", "c"]
    assert rows[0].seq >= 10 and json.loads(rows[0].rawMetadata) == {"x": [1]}
    assert rows[2].matchedProfiles == ["q"]
    assert sorted(r.line for r in bad.collect()) == ["123", "{broken"]


def test_publish_is_versioned_and_ordered(spark, folder):
    root = f"{folder}/store"
    rows = [posting(i, f"https://a.com/{i}") for i in (3, 1, 2)]
    df = spark.createDataFrame(rows, STORED_POSTING)
    for fmt in ("json", "parquet"):
        version = publish_postings(df, root, fmt=fmt)
        assert current_version(spark, root) == version
        back = read_postings(spark, root)[0]
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    # Reading and publishing the same store in one go never overwrites what is read.
    publish_postings(read_published(spark, root).where("seq > 1"), root)
    assert [r.seq for r in read_published(spark, root).orderBy("seq").collect()] == [2, 3]
    assert not [f for f in os.listdir(root) if f.endswith(".tmp")]
    publish_postings(df.limit(0), root)
    assert read_published(spark, root).count() == 0


def listing(seq, source_id, key="indeed"):
    row = dict(seq=seq, source=key, title=f"T{seq}", resultUrl=f"https://x.com/{seq}", sourceJobId=source_id, matchedProfiles=[])
    return tuple(row.get(f) for f in STORED_LISTING.fieldNames())


def test_listing_log_only_grows(spark, folder):
    path = f"{folder}/log"
    append_listings(spark.createDataFrame([listing(1, "a")], STORED_LISTING), path)
    append_listings(spark.createDataFrame([listing(2, "a"), listing(3, None)], STORED_LISTING), path)
    good, _ = read_listings(spark, path)
    assert sorted((r.seq, r.sourceJobId) for r in good.collect()) == [(1, "a"), (2, "a"), (3, None)]
    assert set(LISTING.fieldNames()) < set(good.columns)


def test_registry_and_progress(spark, folder):
    with open(f"{folder}/reg.json", "w") as out:
        json.dump([{"company": "A", "fortuneRank": None, "corporateDomain": "a.com"}, {"company": "B", "fortuneRank": 3}], out)
    rows = read_registry(spark, f"{folder}/reg.json").orderBy("seq").collect()
    assert [(r.seq, r.company, r.fortuneRank) for r in rows] == [(0, "A", None), (1, "B", 3)]
    assert [df.count() for df in read_progress(spark, f"{folder}/nothing")] == [0, 0]
    with open(f"{folder}/cp.json", "w") as out:
        json.dump({"indeed::x::us": {"key": "indeed::x::us", "source": "indeed", "lastPage": 3, "completed": False, "sourceJobIds": ["1", "2"]}}, out)
    progress, seen = read_progress(spark, f"{folder}/cp.json")
    assert progress.first().lastPage == 3 and seen.count() == 2
    with open(f"{folder}/bad.json", "w") as out:
        out.write("{oops")
    assert read_progress(spark, f"{folder}/bad.json")[0].count() == 0
    root = f"{folder}/progress"
    write_progress(progress, seen, root)
    again, ids = read_progress(spark, root)
    assert again.schema == PROGRESS and ids.schema == SEEN_IDS and ids.count() == 2


def test_stream_drops_seen_ids_across_batches(spark, folder):
    write = lambda *rows: append_listings(spark.createDataFrame(list(rows), STORED_LISTING), f"{folder}/in")

    def run():
        good, _ = split_stream(listing_stream(spark, f"{folder}/in"))
        rows = stream_drop_seen(good.select("source", "sourceJobId"), ["source"])
        query = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema("source string, sourceJobId string").parquet(f"{folder}/out").fillna("-").collect()))

    write(listing(1, "a"), listing(2, "a"), listing(3, None))
    assert run() == [("indeed", "-"), ("indeed", "a")]
    write(listing(4, "a"), listing(5, "b"), listing(6, None), listing(7, "a", "monster"))
    assert run() == [("indeed", "-"), ("indeed", "-"), ("indeed", "a"), ("indeed", "b"), ("monster", "a")]


def test_stream_merge_equals_merging_batches_in_turn(spark, folder):
    batches = [[(1, "u1"), (2, "u2")], [(11, "u2"), (12, "u3"), (13, "u3")]]
    as_posting = lambda df: df.selectExpr(
        "seq", "concat('p', seq) as id", "source", "title", "resultUrl as canonicalUrl", "'' as descriptionText", "matchedProfiles", "array(source) as discoveredFrom"
    )

    def postings(df):
        full = as_posting(df)
        from pyspark.sql import functions as F

        return full.select(*[F.col(f.name) if f.name in full.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STORED_POSTING.fields])

    expected = None
    for n, rows in enumerate(batches):
        listings = spark.createDataFrame([listing(s, None)[:7] + (f"https://x.com/{u}",) + listing(s, None)[8:] for s, u in rows], STORED_LISTING)
        append_listings(listings, f"{folder}/in")
        query = stream_merge(split_stream(listing_stream(spark, f"{folder}/in"))[0], f"{folder}/store", f"{folder}/state", postings, lambda b: f"t{b}")
        query.awaitTermination()
        expected = merge_postings(expected, postings(listings), f"t{n}")
    got = read_published(spark, f"{folder}/store")
    want = sorted((r.seq, r.id, r.title, r.discoveredAt, r.lastSeenAt) for r in expected.collect())
    assert sorted((r.seq, r.id, r.title, r.discoveredAt, r.lastSeenAt) for r in got.collect()) == want
    assert [w[0] for w in want] == [1, 2, 12] and want[1][2:] == ("T11", "t0", "t1")
    # Replaying the last batch writes the same version again.
    replay = spark.createDataFrame([listing(s, None)[:7] + (f"https://x.com/{u}",) + listing(s, None)[8:] for s, u in batches[1]], STORED_LISTING)
    merge_version(postings(replay), f"{folder}/store", 2, "t1")
    assert current_version(spark, f"{folder}/store") == 2
    assert sorted((r.seq, r.id, r.title, r.discoveredAt, r.lastSeenAt) for r in read_published(spark, f"{folder}/store").collect()) == want


def test_a_small_batch_rewrites_only_the_ranges_it_changes(spark, folder):
    root = f"{folder}/ranged"
    first = spark.createDataFrame([posting(i, f"https://a.com/{i}") for i in range(100)], STORED_POSTING)
    assert merge_version(first, root, 1, "t0", rows_per_range=10) >= 9
    before = read_ranges(spark, root, 1)
    # One known and one new posting: the range of the known one, and the last or a new one.
    batch = spark.createDataFrame([posting(200, "https://a.com/33"), posting(201, "https://b.com/")], STORED_POSTING)
    assert merge_version(batch, root, 2, "t1", rows_per_range=10) <= 3
    after = read_ranges(spark, root, 2)
    kept = [r for r in after if r["version"] == 1]
    assert len(kept) >= len(before) - 2 and all(r in before for r in kept)
    whole = merge_postings(merge_postings(None, first, "t0"), batch, "t1")
    rows = lambda df: sorted((r.seq, r.id, r.canonicalUrl, r.discoveredAt, r.lastSeenAt) for r in df.collect())
    assert rows(read_published(spark, root)) == rows(whole)
    assert {r.seq for r in read_keys(spark, root).collect()} == {r[0] for r in rows(whole)}
    # Running it again writes the same version; a version that is still in use is not dropped.
    merge_version(batch, root, 2, "t1", rows_per_range=10)
    assert rows(read_published(spark, root)) == rows(whole)
    assert drop_old_versions(spark, root, keep=1) == []
    merge_version(batch.limit(0), root, 3, "t2", rows_per_range=10)
    assert rows(read_published(spark, root)) == rows(whole)


def test_a_store_published_whole_gets_ranges(spark, folder):
    root = f"{folder}/plain"
    first = spark.createDataFrame([posting(i, f"https://a.com/{i}") for i in range(30)], STORED_POSTING)
    publish_postings(first, root)
    merge_version(spark.createDataFrame([posting(99, "https://a.com/7")], STORED_POSTING), root, 2, "t1", rows_per_range=10)
    assert len(read_ranges(spark, root, 2)) >= 2 and read_published(spark, root).count() == 30
    assert drop_old_versions(spark, root, keep=1) == [1] and read_published(spark, root).count() == 30
