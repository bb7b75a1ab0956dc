"""Ranked search against scores computed document by document."""

import math
import random
import re

import pytest

from postloom.llm import strata
from tests.llm.helpers import ODD_TEXTS, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_ranks(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        asked = terms(text)
        weight = {
            t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in d for _, d in held) + 1)))
            for t in set(asked)
        }
        scores = []
        for i, d in held:
            m = 75 + (25 * len(d) * n_docs) // n_terms
            score = sum(weight[t] * ((10**9 * d.count(t)) // (1000 * d.count(t) + 12 * m)) for t in asked)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def ranks(spark, docs, items, k):
    frame = documents(spark, [t for _, t in docs], ids=[i for i, _ in docs])
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, id string")
    return sorted((tuple(r) for r in strata.lexical_ranks(frame, asked, k).collect()), key=repr)


def test_terms():
    for text in [*ODD_TEXTS, "A-Z a_b İ\x7fÀ1 x\x80y", "".join(map(chr, range(300)))]:
        assert [t.decode() for t in strata.terms_of(text)] == terms(text)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed, monkeypatch):
    monkeypatch.setattr(strata, "ROWS_PER_SHARD", 40)
    monkeypatch.setattr(strata, "ROWS_PER_INDEX", 16)
    monkeypatch.setattr(strata, "ITEMS_PER_BLOCK", 3)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 8, 40])))) for i in range(150)]
    docs += [(i, t) for i, t in rng.choices(docs, k=20)] + [(None, "w1 w2"), (None, "w1 w2"), (7, None)]
    items = [(i, " ".join(rng.choices([*words, "unknown"], k=rng.choice([0, 1, 4, 12])))) for i in range(7)]
    items += [(3, "w1 W1 w1"), (None, "w2"), (9, None)]
    assert ranks(spark, docs, items, 5) == brute_ranks(docs, items, 5)


def test_a_third_of_one_document(spark, monkeypatch):
    monkeypatch.setattr(strata, "ROWS_PER_SHARD", 50)
    docs = [(5, "common words here")] * 100 + [(i, f"common w{i}") for i in range(100, 250)]
    items = [(1, "common here"), (2, "w110 w111 common")]
    assert ranks(spark, docs, items, 20) == brute_ranks(docs, items, 20)


def test_odd_texts_and_empty_tables(spark):
    docs = list(enumerate(ODD_TEXTS))
    items = [(1, "word zwei b"), (2, "LONG long"), (3, "漢字"), (4, "!?")]
    assert ranks(spark, docs, items, 3) == brute_ranks(docs, items, 3)
    assert ranks(spark, [], items, 3) == []
    assert ranks(spark, docs, [], 3) == []
    assert ranks(spark, [(1, ""), (2, None)], items, 3) == []
