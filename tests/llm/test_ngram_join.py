"""The Jaccard join against a comparison of all pairs."""

import random

import numpy as np
import pytest

from postloom.llm import ngram_join, queries
from tests.llm.helpers import DATA, HAVE_DATA, ODD_TEXTS, documents
from tests.llm.test_near_copies import edited, shingles


def brute_join(rows):
    """``(id, size, component)`` of each of ``rows`` (id, text), comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        known = [x for x in (least.get(root(k)), i) if x is not None]
        least[root(k)] = min(known, default=None)
    out = [(i, len(sets[k]), least[root(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)]
    return sorted(out, key=repr)


def joined(spark, rows):
    df = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    return sorted((tuple(r) for r in ngram_join.ngram_components(df).collect()), key=repr)


def families(seed):
    draw = random.Random(seed)
    texts = []
    for length in (4, 5, 6, 8, 9, 12, 20, 40, 40, 90, 300):
        base = [f"w{draw.randrange(5000)}" for _ in range(length)]
        for k in range(12):
            words = edited(base, draw, draw.choice((0, 0.01, 0.02, 0.04)))
            texts.append(" ".join(words[: len(words) - draw.choice((0, 0, 1, 2, k))]))
    common = " ".join(f"c{i}" for i in range(30))
    texts += [f"{common} " + " ".join(f"x{draw.randrange(9999)}" for _ in range(n % 20)) for n in range(40)]
    draw.shuffle(texts)
    return list(enumerate(texts))


# All sets heavy, a boundary among the sizes, and the one that costs least.
@pytest.mark.parametrize("boundary", [0, 14, None])
def test_all_pairs(spark, boundary, monkeypatch):
    if boundary is not None:
        monkeypatch.setattr(ngram_join, "choose_boundary", lambda *a: boundary)
    monkeypatch.setattr(ngram_join, "MEMBERS_PER_TASK", 3)
    rows = families(1)
    assert joined(spark, rows) == brute_join(rows)


def test_groups_that_no_leader_joins(spark, monkeypatch):
    """Chains and near misses that share one passage: nothing is lost beyond the leaders."""
    monkeypatch.setattr(ngram_join, "LEADERS", 1)
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 8)  # a filter that lets nearly all pass
    draw = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[k : k + 40]) for k in range(0, 20)]
    texts += [" ".join(base[:40] + [f"y{draw.randrange(999)}" for _ in range(draw.randrange(12))]) for _ in range(40)]
    rows = list(enumerate(texts))
    assert joined(spark, rows) == brute_join(rows)


def test_boundary_is_least_cost(spark):
    def cost_of(texts):
        df = documents(spark, texts)
        sample, part = ngram_join.sampled_sets(df, 5, "text")
        order = ngram_join.Order(ngram_join.common_shingles(sample))
        return ngram_join.choose_boundary(sample, order, part)

    # Short texts that all meet in the lists are light; long ones that meet nobody are heavy.
    draw = random.Random(1)
    short = [" ".join(f"a{draw.randrange(3)}" for _ in range(11)) for _ in range(300)]
    long = [" ".join(f"b{draw.randrange(10**6)}" for _ in range(60)) for _ in range(100)]
    assert 4 <= cost_of(short + long) < 56
    assert cost_of(long) < 56
    assert cost_of([]) == 0


def test_marks_and_parity():
    draw = np.random.default_rng(0)
    order = ngram_join.Order(draw.integers(0, 2**63, 50).astype(np.uint64))
    for n in [*range(4, 60), 150, 400]:
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        gone = draw.integers(0, n // 9 + 1)
        b = np.unique(np.concatenate([a[gone:], draw.integers(0, 2**63, n // 9 + 1 - gone).astype(np.uint64)]))
        bits = np.unpackbits((ngram_join.parity(a) ^ ngram_join.parity(b)).view(np.uint8)).sum()
        assert bits <= len(np.setxor1d(a, b))
        for x, y in ((a, b), (a, b[: n // 3 + 1])):
            assert ngram_join.bits_apart(ngram_join.wide_parity(x), ngram_join.wide_parity(y)) <= len(np.setxor1d(x, y))
        if ngram_join.alike(a, b):
            for boundary in (0, 10, 30, 100):
                assert np.intersect1d(ngram_join.marks(a, order, boundary), ngram_join.marks(b, order, boundary)).size


def test_odd_rows(spark):
    assert joined(spark, list(enumerate(ODD_TEXTS))) == brute_join(list(enumerate(ODD_TEXTS)))
    rows = [(5, "a b"), (None, "A  B"), (None, "c d e f g h"), (None, "c d e f g h"), (7, None), (None, ""), (5, "x y z")]
    rows += [(3, "x y z"), (9, "one\x1cword"), (2, "İ ß"), (1, "i̇ ß")]
    assert joined(spark, rows) == brute_join(rows)
    assert joined(spark, []) == []


@pytest.mark.skipif(not HAVE_DATA, reason="test tables not present")
def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, DATA, "documents").collect()]
    found = queries.QUERIES["op13_ngram_join"](spark, DATA)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_join(rows)
