import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import quality, samples, toxicity
from tests.llm.helpers import ODD_TEXTS, documents

BIG = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels")]


def test_pairs_learn_a_direction():
    draw = np.random.default_rng(0)
    rows = draw.standard_normal((400, 5))
    good = rows[:, 2] - rows[:, 4] > 0.8
    model = quality.fit_pairs(rows, good, pairs=5000)
    assert ((model.score(rows) >= model.cut) == good).mean() > 0.97
    assert quality.fit_pairs(rows, np.ones(400, bool)) is None


def test_quality_of_held_out_documents(tables):
    docs, labels = tables
    model = quality.train(docs, labels, where=~quality.held_out())
    scored = quality.score_documents(docs, model).join(labels, "doc_id").where(quality.held_out())
    rows = scored.collect()
    assert len(rows) > 40 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in rows) >= 0.95 * len(rows)
    bad = [r["score"] for r in rows if r["quality"] == 0]
    ranked = sum(b < r["score"] for b in bad for r in rows if r["quality"] == 1)
    assert ranked >= 0.97 * len(bad) * (len(rows) - len(bad))


def test_held_out_labels_are_not_read(spark, tables):
    docs, labels = tables
    spoiled = labels.withColumn("quality", F.expr("if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality)"))
    models = [quality.train(docs, t, where=~quality.held_out()) for t in (labels, spoiled)]
    assert np.array_equal(models[0].weights, models[1].weights)
    assert models[0].threshold == models[1].threshold


def test_toxic_documents_are_found_and_others_left_alone(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi").repartition(8)
    known = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 > 0)
    model = toxicity.train(docs, known)
    new = labels.join(known, "doc_id", "left_anti")
    rows = toxicity.score_documents(docs, model).join(new, "doc_id").collect()
    found = [(r["p_toxic"] >= toxicity.TOXIC_FROM, r["toxic"]) for r in rows]
    assert sum(1 for p, y in found if p and not y) <= 0.01 * len(found)
    assert sum(1 for p, y in found if p and y) >= 0.85 * sum(y for _, y in found)


def test_later_models_get_out_of_fold_predictions():
    draw = np.random.default_rng(1)
    terms = draw.integers(0, 2, (600, 6)).astype(float)
    first = terms[:, 0] > 0
    last = first | (terms[:, 1] > 0)
    fold = np.arange(600) % 5
    models = toxicity.fit_chain(terms, np.column_stack([first, last]), fold, np.ones(600))
    assert [len(m) for m in models] == [7, 8]
    chain = toxicity.ToxicityModel([b"t"] * 6, np.zeros(6), ("a", "b"), models)
    assert ((chain.probabilities(terms) > 0.5) == np.column_stack([first, last])).all()
    # A category that is noise cannot be learnt from its own rows, so the chain must not lean on it.
    noise = draw.integers(0, 2, 600).astype(bool)
    wide = draw.integers(0, 2, (600, 150)).astype(float)
    models = toxicity.fit_chain(wide, np.column_stack([noise, noise]), fold, np.ones(600))
    assert models[1][150] < 3


def test_one_row_per_id_and_a_bounded_sample(spark):
    labels = spark.createDataFrame(
        [(i % 500, 1 if i < 900 else 0, None) for i in range(1000)] + [(None, 1, 1), (7, None, 1)], LABELS
    )
    known = samples.labelled(labels, "quality", None, "doc_id")
    assert known.count() == 500 and known.where("y = 0").count() == 100
    some = samples.sample(known, {0: 50, 1: 40}, "doc_id", 1).groupBy("y").count().collect()
    counts = {r["y"]: r["count"] for r in some}
    assert 25 <= counts[0] <= 75 and 20 <= counts[1] <= 60


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_texts_no_labels_and_empty_tables(spark, tables, operator):
    df = documents(spark, ODD_TEXTS)
    for labels in (tables[1].where("false"), tables[1].where("quality = 1 and toxic = 0")):
        assert operator.train(tables[0], labels) is None
    model = operator.train(*tables)
    for m in (model, None):
        rows = {r["doc_id"]: r[1:] for r in operator.score_documents(df, m).collect()}
        assert len(rows) == len(ODD_TEXTS)
        assert all(0 <= v <= 1 for r in rows.values() for v in r)
        assert rows[0] == rows[1] and rows[3] == rows[4]
    assert operator.score_documents(df.where("false"), model).collect() == []
    assert operator.train(df.where("false"), tables[1]) is None


def test_quality_learns_from_every_labelled_document(spark, monkeypatch):
    """Rules that only a few documents far beyond any sample show; a label more or less moves the fit."""
    count = 40_000
    numbers = spark.range(count, numPartitions=8)
    text = F.when(F.col("id") % 2 == 0, "some plain words in a row.").otherwise("BAD!!! | 77 ### BAD!!!")
    docs = numbers.select(F.col("id").alias("doc_id"), F.concat(text, F.lit(" "), F.md5(F.col("id").cast("string"))).alias("text"))
    labels = numbers.select(F.col("id").alias("doc_id"), (1 - F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    read, features = [], quality.labelled_features
    monkeypatch.setattr(quality, "labelled_features", lambda *a: read.append(features(*a)) or read[-1])
    one = quality.train(docs, labels)
    other = quality.train(docs.repartition(3), labels.orderBy(F.desc("doc_id")))
    assert [r.count() for r in read] == [count, count]
    assert np.array_equal(one.weights, other.weights) and (one.threshold, one.slope) == (other.threshold, other.slope)
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, one).collect()}
    assert all((scores[i] >= quality.CUT) == (i % 2 == 0) for i in range(count))


@pytest.mark.parametrize("good", [1, 70, 3000])
def test_every_row_is_paired_whatever_the_classes(spark, good):
    width = len(quality.FEATURES)
    draw = np.random.default_rng(2)
    values = draw.standard_normal((good + 3000, width))
    rows = spark.createDataFrame([(i, int(i < good), v.tolist()) for i, v in enumerate(values)], "id long, y int, features array<double>")
    middle, spread = quality.moments(rows)
    assert np.allclose(middle, values.mean(axis=0)) and np.allclose(spread, values.std(axis=0))
    pairs = quality.paired(rows, {1: good, 0: 3000}, np.zeros(width), np.ones(width), 10, 5)
    apart = np.array([r["apart"] for r in pairs.collect()])
    assert len(apart) >= 3000
    if good == 1:
        assert np.allclose(np.unique(apart[:, 0]), np.unique(values[0, 0] - values[1:, 0]))
    pull, curve = quality.pair_sums(pairs, np.full(width, 0.1))
    lost = quality.wrong(apart, np.full(width, 0.1))
    assert np.allclose(pull, apart.T @ lost, atol=1e-3)
    assert np.allclose(curve, (apart * (lost * (1 - lost))[:, None]).T @ apart, atol=1e-3)


def test_values_by_rank(spark):
    values = [3.0, 1.0, 1.0, -2.5, 7.25, 7.25, 7.25, 1e9, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "raw double")
    assert [quality.ranked(df, k + 1) for k in range(len(values))] == sorted(values)
