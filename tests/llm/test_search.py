"""Exact and approximate search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import ann, topk
from tests.llm.helpers import DATA, HAVE_DATA

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, score int, rank int"


def frame(spark, vectors, ids=None):
    rows = [
        (i if ids is None else ids[i], None if v is None else [None if x is None else float(x) for x in v], 0, "", "", 0, 0)
        for i, v in enumerate(vectors)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def brute(ids, scores, query, k):
    order = sorted((-s, i) for i, s in zip(ids, scores, strict=True) if i != query)[:k]
    return [(r + 1, i, -s) for r, (s, i) in enumerate(order)]


def lists(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in found.items()}


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(1)
    rows = draw.standard_normal((700, 24)).astype(np.float32)
    rows[100:300] = rows[7]  # a large group of equal vectors
    rows[500:520, 3] += 1e-3
    return rows


def test_exact_top_with_ties(spark, vectors):
    whole = np.floor(1024 * vectors.astype(np.float64)).astype(np.int64)
    got = lists(topk.exact_top(frame(spark, vectors), F.col("vec_id") % 50 == 0, k=10, rows_per_shard=64))
    assert set(got) == set(range(0, 700, 50))
    for q, rows in got.items():
        assert rows == brute(range(700), (whole @ whole[q]).tolist(), q, 10)


def test_exact_scores_beyond_doubles(spark):
    big = [[2.0**43, 1.0], [2.0**43, 0.0], [0.5, 1.0], [3e38, -3e38]]
    got = lists(topk.exact_top(frame(spark, big), F.col("vec_id") == 0))
    assert got[0] == [(1, 1, (1 << 63) - 1), (2, 3, (1 << 63) - 1), (3, 2, (1 << 62) + (1 << 20))]


def test_approximate_search_finds_nine_in_ten(spark, vectors):
    wide = vectors.astype(np.float64)
    got = lists(ann.nearest(frame(spark, vectors), F.col("vec_id") % 10 == 0, k=20, rows_per_shard=64))
    hits = 0
    for q, rows in got.items():
        best = brute(range(700), (wide * wide[q]).sum(axis=1).tolist(), q, 20)
        hits += len({i for _, i, _ in best} & {i for _, i, _ in rows})
        assert [r for r, _, _ in rows] == list(range(1, 21))
        for _, i, s in rows:
            assert s == pytest.approx(float(wide[i] @ wide[q]), abs=1e-12)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
    assert hits >= 0.9 * 20 * 70


def test_estimates_keep_their_bounds():
    draw = np.random.default_rng(2)
    rows, query = draw.standard_normal((2000, 64)), draw.standard_normal(64)
    coder = ann.fit(rows)
    codes, centre, length, agree = coder.encode(rows)
    signs = np.unpackbits(codes, axis=1) * 2.0 - 1
    bits = signs.shape[1]
    about = coder.centroids[centre] @ query + length * (signs @ (coder.rotation @ query)) / (agree * np.sqrt(bits))
    bound = length * np.sqrt(1 / agree**2 - 1) * 2.5 / np.sqrt(bits - 1) * np.sqrt(query @ query)
    assert (np.abs(about - rows @ query) <= bound).mean() > 0.97


ODD = [[1, 2], None, [], [float("nan"), 1], [float("inf"), 1], [None, 1], [0, 0], [1, 2], [3, 1], [1, 2, 3]]


def test_odd_vectors(spark):
    exact = lists(topk.exact_top(frame(spark, ODD), F.col("vec_id") < 20))
    assert set(exact) == {0, 6, 7, 8}
    assert [i for _, i, _ in exact[0]] == [7, 8, 6] or [i for _, i, _ in exact[0]] == [8, 7, 6]
    near = lists(ann.nearest(frame(spark, ODD), F.col("vec_id") < 20))
    assert set(near) == {0, 7, 8} and [i for _, i, _ in near[8]] == [0, 7]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = frame(spark, [[1, 0]] * 5, ids=[0, 0, 1, 1, None])
    assert [(i, s) for _, i, s in lists(topk.exact_top(df, F.col("vec_id") == 0))[0]] == [(1, 1 << 20)] * 2
    assert topk.exact_top(df.where("false"), F.col("vec_id") == 0).collect() == []
    assert ann.nearest(df.where("false"), F.col("vec_id") == 0).collect() == []
    assert ann.nearest(df, F.lit(False)).collect() == []


@pytest.mark.skipif(not HAVE_DATA, reason="test tables not present")
def test_recall_on_the_whole_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = df.toPandas()
    ids, wide = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(np.float64)
    got = lists(ann.nearest(df, F.col("vec_id") % 20 == 0, k=20))
    hits = total = 0
    for q in ids[ids % 20 == 0].tolist():
        scores = (wide * wide[ids == q][0]).sum(axis=1).tolist()
        hits += len({i for _, i, _ in brute(ids.tolist(), scores, q, 20)} & {i for _, i, _ in got[q]})
        total += 20
    assert hits >= 0.9 * total
