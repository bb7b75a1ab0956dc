import random

import pytest

import corpus_pipeline
from postloom.llm import near_copies, queries
from tests.llm.helpers import DATA, HAVE_DATA, ODD_TEXTS, documents


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts):
    """Ids left of ``{id: text}`` when all pairs are compared."""
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    ids = sorted(texts)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return sorted(i for i in ids if label[i] == i)


def edited(words, draw, share):
    return [draw.choice("abcdefgh") * 3 if draw.random() < share else w for w in words]


def test_edited_copies_against_all_pairs(spark):
    draw = random.Random(5)
    texts = []
    for length in (6, 40, 40, 200, 900):
        base = [f"w{draw.randrange(5000)}" for _ in range(length)]
        texts += [" ".join(base)] + [" ".join(edited(base, draw, draw.choice((0.01, 0.02, 0.04)))) for _ in range(14)]
    common = " ".join(f"c{i}" for i in range(30))
    texts += [f"{common} " + " ".join(f"x{draw.randrange(9999)}" for _ in range(n)) for n in range(0, 20)]
    draw.shuffle(texts)
    kept = near_copies.keep_first(documents(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == brute_kept(dict(enumerate(texts)))


@pytest.mark.skipif(not HAVE_DATA, reason="test tables not present")
def test_stage_against_all_pairs(spark):
    df = queries.table(spark, DATA, "documents")
    kept = corpus_pipeline.near_duplicate_stage(spark, df, DATA)
    want = brute_kept({r["doc_id"]: r["text"] for r in df.collect()})
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_odd_texts_repeated_and_null_ids(spark):
    df = documents(spark, ODD_TEXTS)
    kept = near_copies.keep_first(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept(dict(enumerate(ODD_TEXTS)))
    assert kept.columns == df.columns and near_copies.keep_first(df.where("false")).collect() == []
    repeated = documents(spark, ["a b", "c d", "c d", "a b", "e f", "e f", "a b"], ids=[1, 1, 1, 2, None, None, None])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near_copies.keep_first(repeated).collect()) == [
        (0, "e f"), (1, "a b"), (1, "c d"),
    ]
