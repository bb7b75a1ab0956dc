"""The set-based merge against a plain row-by-row fold."""

import random

import pytest

from postloom.operators.merge import (
    assign_slots, dedup_by_identity, dedup_by_text, dedup_by_url, link_components, merge_postings, merge_with_keys, tier_keys,
)
from postloom.schemas import STORED_POSTING

NOW = "2026-02-01T00:00:00.000Z"


def fold(rows):
    """Slot of every (seq, is_store, k1..k4), one row at a time."""
    held = [{}, {}, {}, {}]
    slots, slot_of = [], {}
    for seq, stored, *keys in rows:
        at = None
        if not stored:
            at = next((held[t][k] for t, k in enumerate(keys) if k is not None and k in held[t]), None)
        if at is None:
            slots.append((seq, keys))
            at = len(slots) - 1
        else:
            for t, k in enumerate(slots[at][1]):
                if k is not None and held[t].get(k) == at:
                    del held[t][k]
            slots[at] = (slots[at][0], keys)
        for t, k in enumerate(keys):
            if k is not None:
                held[t][k] = at
        slot_of[seq] = slots[at][0]
    return slot_of


def cases(seed, groups=400):
    rnd = random.Random(seed)
    shape = [(g, rnd.randint(0, 5), rnd.randint(1, 9), rnd.choice([2, 3, 5])) for g in range(groups)]
    rows, seq = [], 0
    for stored in (True, False):
        order = [(g, m) for g, s, b, m in shape for _ in range(s if stored else b)]
        rnd.shuffle(order)
        for g, m in order:
            keys = [f"{g}-{rnd.randint(0, m)}".encode() if rnd.random() < 0.8 else None for _ in range(4)]
            rows.append((seq, stored, *keys))
            seq += 1
    # One text shared by many rows, with two URLs taking turns: the longest possible dependency.
    for i in range(150):
        rows.append((seq, False, b"A" if i % 2 else b"B", None, rnd.choice([None, b"q%d" % (i % 7)]), b"hot"))
        seq += 1
    return rows


@pytest.mark.parametrize("seed, blocks, per_range, parts", [(1, None, 1_000_000, 1), (2, 4, 100, 7), (3, 2, 1_000_000, 64)])
def test_slots_equal_sequential_fold(spark, seed, blocks, per_range, parts):
    rows = cases(seed)
    df = spark.createDataFrame(random.Random(0).sample(rows, len(rows)), "seq long, is_store boolean, k1 binary, k2 binary, k3 binary, k4 binary")
    df = df.repartition(parts).persist()
    slots = assign_slots(df.where("is_store").drop("is_store"), df.where("not is_store").drop("is_store"), blocks, per_range)
    got = {r.seq: r.slot for r in slots.collect()}
    assert {s: got.get(s, s) for s, *_ in rows} == fold(rows)
    df.unpersist()


def test_components_equal_union_find(spark):
    rows = cases(5, 120)
    df = spark.createDataFrame(rows, "seq long, is_store boolean, k1 binary, k2 binary, k3 binary, k4 binary").drop("is_store")
    got = {r.seq: r.component for r in link_components(df, hot_rows=2).collect()}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for seq, _, *keys in rows:
        for t, k in enumerate(keys):
            if k is not None:
                a, b = sorted((find(seq), find(first.setdefault((t, k), seq))))
                root[b] = a
    assert got == {s: find(s) for s in root}


def job(seq, **over):
    base = dict(
        seq=seq, id=f"id-{seq}", source="acme-greenhouse", sourceType="greenhouse", company="Acme", title="Senior SDET", location="Remote",
        requisitionId="123", discoveredAt="2026-01-01", lastSeenAt="2026-01-01", canonicalUrl="https://acme.com/jobs/123",
        applyUrl="https://acme.com/jobs/123", descriptionText="We need a great SDET with 5 years experience.", requiredYears=5,
        matchedProfiles=["sdet"], discoveredFrom=["acme-greenhouse"], rawMetadata="{}",
    )
    base.update(over)
    return base


def fields(row):
    return tuple(row.get(f) for f in STORED_POSTING.fieldNames())


# Each scenario is a store, a batch and what must come out as (id, chosen fields).
URL_A, URL_B = "https://acme.com/a", "https://acme.com/b"
NO_REQ = dict(requisitionId=None)
SCENARIOS = {
    "new row": ([], [job(9)], [("id-9", {"discoveredAt": NOW, "lastSeenAt": NOW})]),
    "url match keeps id and first date": (
        [job(1)],
        [job(9, title="Lead SDET II")],
        [("id-1", {"discoveredAt": "2026-01-01", "lastSeenAt": NOW, "title": "Lead SDET II"})],
    ),
    "requisition": (
        [job(1, canonicalUrl=URL_A)],
        [job(9, canonicalUrl=URL_B, title="x y", descriptionText="other text here")],
        [("id-1", {"title": "x y"})],
    ),
    "identity": (
        [job(1, canonicalUrl=URL_A, **NO_REQ)],
        [job(9, canonicalUrl=URL_B, title="  senior sdet ", location="REMOTE", descriptionText="different text", **NO_REQ)],
        [("id-1", {"location": "REMOTE"})],
    ),
    "text": (
        [job(1, canonicalUrl=URL_A, **NO_REQ)],
        [job(9, canonicalUrl=URL_B, title="SDET II", location="SF", **NO_REQ)],
        [("id-1", {"location": "SF"})],
    ),
    "nothing in common": (
        [job(1, canonicalUrl=URL_A, **NO_REQ)],
        [job(9, canonicalUrl=URL_B, title="SDET II", descriptionText="different text", **NO_REQ)],
        [("id-1", {"lastSeenAt": "2026-01-01"}), ("id-9", {"lastSeenAt": NOW})],
    ),
    "freed url can be used again": (
        [job(1, canonicalUrl=URL_A, requisitionId="1", descriptionText="Original posting one.")],
        [
            job(8, canonicalUrl=URL_B, requisitionId="1", descriptionText="Updated posting one."),
            job(9, canonicalUrl=URL_A, requisitionId="2", title="Other Job", descriptionText="Completely different."),
        ],
        [("id-1", {"requisitionId": "1"}), ("id-9", {"requisitionId": "2"})],
    ),
    "empty texts stay apart": (
        [],
        [job(i, canonicalUrl=f"https://acme.com/{i}", requisitionId=str(i), title=f"Engineer {i}x", descriptionText="") for i in (7, 8, 9)],
        [("id-7", {}), ("id-8", {}), ("id-9", {})],
    ),
    **{
        f"title {title!r} is no identity": (
            [],
            [job(i, canonicalUrl=f"https://acme.com/{i}", requisitionId=str(i), title=title, descriptionText=f"Distinct body {i}.") for i in (8, 9)],
            [("id-8", {}), ("id-9", {})],
        )
        for title in ("", "   ", "Software Engineer")
    },
    "arrays are united in order": (
        [job(1, discoveredFrom=["a", "b"], matchedProfiles=["x"])],
        [job(8, discoveredFrom=["c", "a"], matchedProfiles=["y", "x"]), job(9, discoveredFrom=None, matchedProfiles=None)],
        [("id-1", {"discoveredFrom": ["a", "b", "c", "arrays are united in order/acme-greenhouse"], "matchedProfiles": ["x", "y"]})],
    ),
    "stored rows never match each other": (
        [job(1, discoveredFrom=None, matchedProfiles=["x", "x"]), job(2)],
        [job(9, title="Tester", descriptionText="", discoveredFrom=None, **NO_REQ)],
        [("id-1", {"discoveredFrom": None, "matchedProfiles": ["x", "x"], "lastSeenAt": "2026-01-01"}), ("id-2", {"lastSeenAt": NOW, "title": "Tester"})],
    ),
    "null urls do not match": (
        [],
        [job(i, canonicalUrl=None, title="", descriptionText="", **NO_REQ) for i in (8, 9)],
        [("id-8", {}), ("id-9", {})],
    ),
}


@pytest.fixture(scope="module")
def merged(spark):
    """All scenarios in one merge, kept apart by their keys."""
    store, batch = [], []
    for n, (name, (old, new, _)) in enumerate(SCENARIOS.items()):
        for rows, out in ((old, store), (new, batch)):
            for row in rows:
                own = dict(row, salaryText=name, source=f"{name}/{row['source']}", company=f"{name}/{row['company']}")
                own["seq"] = row["seq"] * 1000 + n
                if row["canonicalUrl"]:
                    own["canonicalUrl"] = row["canonicalUrl"].replace("acme.com", f"s{n}.acme.com")
                if row["descriptionText"]:
                    own["descriptionText"] = f"{n}: {row['descriptionText']}"
                out.append(fields(own))
    rows = merge_postings(spark.createDataFrame(store, STORED_POSTING), spark.createDataFrame(batch, STORED_POSTING), NOW).collect()
    return sorted(rows, key=lambda r: r.seq)


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenario(merged, name):
    rows = [r for r in merged if r.salaryText == name]
    expected = SCENARIOS[name][2]
    assert [(r.id, {f: r[f] for f in want}) for r, (_, want) in zip(rows, expected)] == expected
    assert len(rows) == len(expected)


def test_second_run_of_the_same_batch(spark):
    batch = [job(i, canonicalUrl=f"https://a.com/{i}", requisitionId=str(i), title=f"Role {i}", descriptionText=f"Body number {i} text") for i in range(5)]
    make = lambda rows, at: spark.createDataFrame([fields(dict(r, seq=r["seq"] + at)) for r in rows], STORED_POSTING)
    once, keys = merge_with_keys(None, make(batch, 0), "t1")
    twice = merge_postings(once, make(batch, 100), "t2", store_keys=keys).collect()
    assert sorted(r.seq for r in twice) == list(range(5))
    assert {(r.discoveredAt, r.lastSeenAt) for r in twice} == {("t1", "t2")}


def test_published_keys_equal_fresh_keys(spark):
    rnd = random.Random(4)
    rows = [
        job(i, canonicalUrl=f"https://a.com/{rnd.randint(0, 20)}", requisitionId=str(rnd.randint(0, 20)), title=f"Role {rnd.randint(0, 9)}",
            descriptionText=f"Body number {rnd.randint(0, 30)}")
        for i in range(60)
    ]
    make = lambda part: spark.createDataFrame(list(map(fields, part)), STORED_POSTING)
    merged, keys = merge_with_keys(make(rows[:20]), make(rows[20:]), NOW)
    assert sorted(map(tuple, keys.collect())) == sorted(map(tuple, tier_keys(merged).collect()))
    before, after = 20, merged.count()
    assert before <= after <= 60
    kept = {r.id for r in merged.select("id").collect()}
    assert {f"id-{i}" for i in range(20)} <= kept


def test_single_tier_variants(spark):
    df = spark.createDataFrame(
        [(1, "a", "http://x.com/1", "Acme", "Role", "NY", "long enough text"), (2, "b", "http://X.com/1/", "acme", " role", "ny", "short"),
         (3, "c", "http://x.com/2", "Acme", "engineer", "NY", "Long  enough text")],
        "seq long, id string, canonicalUrl string, company string, title string, location string, descriptionText string",
    )
    assert sorted((r.seq, r.id, r.title) for r in dedup_by_url(df).collect()) == [(1, "a", " role"), (3, "c", "engineer")]
    assert sorted(r.id for r in dedup_by_identity(df).collect()) == ["a", "c"]
    assert sorted((r.id, r.title) for r in dedup_by_text(df).collect()) == [("a", "engineer"), ("b", " role")]
