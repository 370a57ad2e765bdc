from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import scores
from pairloom.operators import metrics, pairs, sampling, weights

SCHEMA = "domain_i string, domain_j string, score float"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def test_bins_at_edges(spark):
    values = [0.0, 0.3, 0.35, 0.6, 0.7, 0.9, 1.0]
    rows = table(spark, [("a", "b", v) for v in values])
    got = [tuple(r) for r in rows.select(scores.score_bin(F.col("score"), 5), scores.score_bin(F.col("score"), 10), scores.reservoir_bin(F.col("score"), 10)).collect()]
    assert got == [(0, 0, 0), (1, 3, 3), (1, 3, 3), (3, 6, 6), (3, 7, 6), (4, 9, 8), (5, 10, 9)]


def test_fraction_and_label(spark):
    rows = table(spark, [("a", "b", v) for v in (0.87, 0.25, 0.7, 0.71)])
    got = [tuple(r) for r in rows.select(scores.fraction_score(F.col("score")), scores.binary_score(F.col("score"), 0.7)).collect()]
    assert got == [(0.9, 1.0), (0.2, 0.0), (0.7, 0.0), (0.7, 1.0)]


def test_weights_of_a_bin_sum_to_one(spark):
    rows = table(spark, [("a", str(k), (k % 11) / 10) for k in range(200)])
    sums = weights.weighted(rows, 5, 0.25).groupBy(scores.score_bin(F.col("score"), 5).alias("b")).agg(F.sum("weight").alias("w")).collect()
    assert {r.b: round(r.w, 9) for r in sums} == {0: 1.0, 1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 4.0}


def test_bad_scores_have_no_weight(spark):
    rows = table(spark, [("a", "b", float("nan")), ("a", "b", 1.5), ("a", "b", -0.1), ("a", "b", None), ("a", "b", 0.5)])
    assert weights.histogram(rows).agg(F.sum("n")).first()[0] == 1


def test_exclude_and_touching_with_nulls_and_clashing_names(spark):
    rows = table(spark, [("a", "b", 0.1, 1), ("a", "c", 0.2, 2), (None, "b", 0.3, 3), ("NA", "d", 0.4, 4)], SCHEMA + ", id int")
    ids = spark.createDataFrame([("c",), (None,), ("c",)], "id string")
    assert {r.id for r in pairs.exclude(rows, ids).collect()} == {1, 3, 4}
    assert {r.id for r in pairs.touching(rows, ids).collect()} == {2}
    assert pairs.known(rows, ids).count() == 0


def test_empty_tables(spark):
    none = table(spark, [])
    ids = spark.createDataFrame([], "id string")
    assert pairs.exclude(none, ids).count() == pairs.unique_ids(none).count() == weights.histogram(none).count() == 0
    assert weights.binary_weighted(none, 0.5).count() == sampling.reservoirs(none, 10, 5, F.lit(1)).count() == 0
    assert pairs.numbered(none, "score").count() == 0


def test_split_keeps_everything_once(spark):
    rows = table(spark, [(str(i), str(j), 0.5) for i in range(12) for j in range(12)])
    classes = spark.createDataFrame([(str(k), f"c{k % 5}", k) for k in range(12)], "domain string, class string, ord int")
    fold = pairs.fold_slice(classes, 1, 4, "ord")
    assert [r["class"] for r in fold.collect()] == ["c1"]
    train, test = pairs.fold_split(rows, classes, fold)
    assert train.count() + test.count() == 144
    assert {r.domain_i for r in train.collect()} & {"1", "6", "11"} == set()


def test_sanitise(spark):
    lines = spark.createDataFrame([("a,b,0.5",), ("a,x,0.5",), ("",), ("alone",), ("b,a",), ("a,b,0.5",)], "value string")
    catalog = spark.createDataFrame([("a",), ("b",)], "domain string")
    kept, missing, counters = pairs.sanitise(lines, catalog)
    assert sorted(r.value for r in kept.collect()) == ["a,b,0.5", "a,b,0.5", "b,a"]
    assert [r.domain for r in missing.collect()] == ["x"]
    assert counters.first().asDict() == {"total": 5, "kept": 3, "dropped": 1, "malformed": 1}


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 400), st.data())
def test_pair_at_index_is_the_triangle(n, data):
    k = data.draw(st.integers(0, n * (n - 1) // 2 - 1))
    x, y = pairs.pair_at_index(n, k)
    assert 0 <= x < y < n
    assert x * (2 * n - x - 1) // 2 + y - x - 1 == k


def test_pair_at_index_of_the_first_row_end():
    assert pairs.pair_at_index(15229, 15228) == (1, 2)
    with pytest.raises(IndexError):
        pairs.pair_at_index(4, 6)


def test_reservoirs_are_bounded_and_skip_nan(spark):
    rows = table(spark, [("a", str(k), k / 1000) for k in range(1000)] + [("a", "nan", float("nan"))] * 5)
    kept = sampling.reservoirs(rows, 50, 5, sampling.uniform("domain_j", seed=3))
    counts = {r.b: r.n for r in kept.groupBy(scores.reservoir_bin(F.col("score"), 5).alias("b")).agg(F.count("*").alias("n")).collect()}
    assert counts == {k: 10 for k in range(5)}
    again = sampling.reservoirs(rows.repartition(7), 50, 5, sampling.uniform("domain_j", seed=3))
    assert sorted(r.domain_j for r in kept.collect()) == sorted(r.domain_j for r in again.collect())


def test_weighted_sampling_follows_the_weights(spark):
    rows = spark.range(100).select(F.col("id"), F.when(F.col("id") < 10, 9.0).when(F.col("id") < 20, 0.0).otherwise(0.125).alias("w"))
    draws = spark.range(4000).select(F.col("id").alias("draw"), sampling.uniform("id", seed=5).alias("u"))
    got = sampling.weighted_with_replacement(rows, draws, "w", ["id"], 4)
    share = got.agg(F.avg((F.col("id") < 10).cast("double")).alias("top"), F.count_if(F.col("id").between(10, 19)).alias("zero"), F.count("*").alias("n")).first()
    assert share.n == 4000 and share.zero == 0 and abs(share.top - 0.9) < 0.03
    ones = sampling.weighted_without_replacement(rows, 50, "w", sampling.uniform("id", seed=6), ["id"])
    assert ones.count() == ones.distinct().count() == 50 and ones.where("w = 0").count() == 0


def test_learning_rate(spark):
    values = [r[0] for r in spark.range(0, 101, 10).select(scores.learning_rate(F.col("id"), 10, 100)).collect()]
    assert values[0] == 1e-6 and values[1] == 1.0 and math.isclose(values[-1], 0.0, abs_tol=1e-12)


@pytest.mark.parametrize("n", [0, 7, 40, 60])
def test_first_rows_by_place_and_at_once(spark, n):
    rows = spark.range(50).select(F.col("id"), (F.col("id") * 37 % 11).alias("key")).repartition(5)
    want = sorted(((k * 37 % 11, k) for k in range(50)))[:n]
    for at_once in (0, 100):
        got = pairs.first_rows(rows, n, "key", "id", at_once=at_once)
        assert got.columns == ["id", "key"] and sorted((r.key, r.id) for r in got.collect()) == want


def test_all_pairs_once_whatever_the_blocks(spark):
    items = spark.createDataFrame([(f"k{k:02d}",) for k in range(23)], "key string")
    assert [pairs.blocks(items), pairs.blocks(items, 1, 5), pairs.blocks(items.limit(0), 1)] == [8, 5, 1]
    for block in (None, 1, 7):
        every = [(r.key_i, r.key_j) for r in pairs.all_against_all(items, "key", ["key"], block).collect()]
        assert len(every) == len(set(every)) == 23 * 22 // 2 and all(a < b for a, b in every)
        both = [(r.key_i, r.key_j) for r in pairs.set_against_set(items, items.limit(4), ["key"], block).collect()]
        assert len(both) == len(set(both)) == 23 * 4


def test_areas_by_worker(spark):
    rows = spark.range(600).select((F.col("id") % 3).alias("w"), (F.col("id") * 7919 % 5 < 2).cast("int").alias("label"), (F.col("id") * 104729 % 83).alias("pred"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1, 5)], "w long, label int, pred long"))
    for area in (metrics.roc_auc, metrics.pr_auc):
        got = {r[0]: r[1] for r in area(rows, "label", "pred", 4, ["w"]).collect()}
        assert got == {k: pytest.approx(area(rows.where(F.col("w") == k), "label", "pred", 4).first()[0]) for k in range(3)}
