import random
import re

import pytest
import xxhash

from postloom.llm import simhash
from postloom.llm.graph import components
from tests.llm.helpers import DATA, HAVE_DATA, ODD_TEXTS, documents


def brute_fingerprint(text, width=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))




def brute_components(fps, distance):
    label = {i: i for i in fps}
    ids = sorted(fps)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[b] < label[a] and bin(fps[a] ^ fps[b]).count("1") <= distance:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("text", [t for t in ODD_TEXTS if len(t or "") < 1000] + ["A b a B a b", "a b c"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_near_pairs_against_all_pairs(spark):
    draw = random.Random(3)
    centres = [draw.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    values = set(centres)
    for c in centres:
        for _ in range(25):
            flips = draw.sample(range(64), draw.randint(1, 5))
            values.add(c ^ sum(1 << b for b in flips))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for distance in (0, 2, 3):
        got = {(r["a"], r["b"]) for r in simhash.near_pairs(df, distance).collect()}
        want = {
            (a, b)
            for i, a in enumerate(signed)
            for b in signed[i + 1 :]
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance
        }
        assert got == want
    with pytest.raises(ValueError, match="at most"):
        simhash.near_pairs(df, 4)


@pytest.mark.skipif(not HAVE_DATA, reason="test tables not present")
def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in df.collect()}
    want = brute_components(fps, 2)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_chains_are_one_component(spark):
    chain = [(i, i + 1) for i in range(60)]
    nodes = spark.createDataFrame([(i, 1000 - i) for i in range(63)], "node long, label long")
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r["node"]: r["label"] for r in components(nodes, edges).collect()}
    assert got == {i: 940 if i <= 60 else 1000 - i for i in range(63)}


def test_odd_texts_null_ids_and_empty_table(spark):
    df = documents(spark, ODD_TEXTS)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[4] == 3 and got[5] == 5
    nameless = documents(spark, ["a b", "a b", "c d"], ids=[None, 5, None])
    rows = simhash.near_duplicates(nameless).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == [(0, 0), (0, 5), (5, 5)]
    kept = simhash.keep_first(nameless, simhash.near_duplicates(nameless))
    assert sorted(r["text"] for r in kept.collect()) == ["a b", "c d"]
    assert kept.columns == nameless.columns
    assert simhash.near_duplicates(df.where("false")).collect() == []


def test_one_of_each_group_stays(spark):
    df = documents(spark, ["same text here"] * 4 + ["other words entirely"], ids=[3, 3, 4, 9, 1])
    kept = simhash.keep_first(df, simhash.near_duplicates(df)).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]
