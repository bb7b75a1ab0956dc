from collections import defaultdict

import pytest

from postloom.llm import mixing
from tests.llm.helpers import ODD_TEXTS, documents


def test_targets_are_met_and_capped(spark):
    texts = ["w " * (1 + i * 7919 % 97) for i in range(900)]
    sources = [None if i % 7 == 0 else f"s{i % 3}" for i in range(900)]
    df = documents(spark, texts, sources)
    rows = mixing.pareto_mix(df).collect()
    again = mixing.pareto_mix(df.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    total = sum(r["size"] for r in rows)
    by_source = defaultdict(list)
    for r in rows:
        by_source[sources[r["doc_id"]]].append(r)
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] in (0, 1, 2)
    assert sum(g[0]["target"] for g in by_source.values()) == pytest.approx(1.5 * total)
    for group in by_source.values():
        largest = max(r["size"] for r in group)
        assert group[0]["source_size"] == sum(r["size"] for r in group)
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= largest / 2
        assert group[0]["target"] <= 2 * group[0]["source_size"] + 1e-9
    # Weights 3, 1, 2, 3 in the order s0, s1, s2, null; s1 is not filled up.
    assert by_source["s1"][0]["target"] * 2 == pytest.approx(by_source["s2"][0]["target"])


def test_sharing_fills_up_and_shares_the_rest(spark):
    df = spark.createDataFrame([("a", 3, 10), ("b", 1, 100), ("c", 2, 100)], "g string, share int, limit long")
    got = {r["g"]: r["target"] for r in mixing.share_out(df, 100.0, "share", "limit").collect()}
    assert got == pytest.approx({"a": 10, "b": 30, "c": 60})


def test_odds_change_who_is_taken(spark):
    df = documents(spark, ["a b c d"] * 600).selectExpr("*", "if(doc_id < 300, 5.0, 0.5) as liking")
    rows = mixing.pareto_mix(df, odds="liking").collect()
    liked = sum(r["taken"] for r in rows if r["doc_id"] < 300)
    assert liked > 1.15 * sum(r["taken"] for r in rows if r["doc_id"] >= 300)


def test_odd_texts_and_kept_columns(spark):
    df = documents(spark, ODD_TEXTS, [None, "", "a", "a", "a", "b", "b", "b", "b"])
    rows = {r["doc_id"]: r for r in mixing.pareto_mix(df).collect()}
    assert [rows[i]["size"] for i in range(9)] == [0, 0, 0, 1, 1, 2, 7, 40_000, 1]
    kept = mixing.pareto_mix(df, keep=df.columns)
    assert kept.columns == [*df.columns, "copies"]
    assert {r["doc_id"]: r["copies"] for r in kept.collect()} == {i: r["copies"] for i, r in rows.items()}


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = documents(spark, ["a b c"] * 40, ids=[1] * 20 + [None] * 20)
    rows = mixing.pareto_mix(df).collect()
    assert len(rows) == 40 and abs(sum(r["taken"] for r in rows) - 180) <= 2
    assert mixing.pareto_mix(df.where("false")).collect() == []
