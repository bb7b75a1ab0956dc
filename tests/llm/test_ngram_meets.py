"""What the buckets of the Jaccard join pair."""

import random

import numpy as np

from postloom.llm import ngram_join
from tests.llm.helpers import documents


def test_sets_that_sizes_or_parities_rule_out_are_not_paired(spark, monkeypatch):
    draw = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"x{draw.randrange(10**6)}" for _ in range(120 + n)) for n in range(40)]
    texts += [texts[0] + " one more", texts[0] + " two more"]
    verify, paired = ngram_join.Joined.verify, []

    def counted(self, pairs):
        paired.append(pairs.count())
        return verify(self, pairs)

    monkeypatch.setattr(ngram_join.Joined, "verify", counted)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(documents(spark, texts)).collect()}
    assert found == {i: 0 if i > 39 else i for i in range(42)}
    assert paired[0] <= 3


def test_pairs_of_all_steps_are_ruled_out_before_they_are_made(spark, monkeypatch):
    """Texts of many sizes that share one passage and no more: leaders and the last step pair none of them."""
    draw = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"x{draw.randrange(10**6)}" for _ in range(120 + 3 * n)) for n in range(60)]
    described, asked = ngram_join.Joined.described, []

    def counted(self, pairs):
        asked.append(pairs.count())
        return described(self, pairs)

    monkeypatch.setattr(ngram_join.Joined, "described", counted)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(documents(spark, texts)).collect()}
    assert found == {i: i for i in range(60)}
    assert sum(asked) <= 3


def test_first_shared_shingle_keeps_every_link():
    draw = np.random.default_rng(4)
    order = ngram_join.Order(draw.integers(0, 2**63, 50).astype(np.uint64))
    for n in [*range(4, 60), 150, 400]:
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        gone = draw.integers(0, n // 9 + 1)
        b = np.unique(np.concatenate([a[gone:], draw.integers(0, 2**63, n // 9 + 1 - gone).astype(np.uint64)]))
        if not ngram_join.alike(a, b):
            continue
        for boundary in (0, 10, 30, 100):
            one, other = (ngram_join.marks(s, order, boundary) for s in (a, b))
            at = [
                ngram_join.places(np.array([len(s)]), np.array([len(m)]), boundary) for s, m in ((a, one), (b, other))
            ]
            listed = [dict(zip(m[p >= 0].tolist(), p[p >= 0].tolist())) for m, p in zip((one, other), at)]
            subsets = np.intersect1d(one[at[0] < 0], other[at[1] < 0]).size
            shared = min(((i, listed[1][x]) for x, i in listed[0].items() if x in listed[1]), default=None)
            if shared is None:
                assert subsets
                continue
            i, j = shared
            assert listed[0] == {x: k for k, x in enumerate(order.first(a, len(listed[0])).tolist())}
            assert 9 * (i + j + abs((len(a) - i) - (len(b) - j))) <= len(a) + len(b)
