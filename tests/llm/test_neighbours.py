from __future__ import annotations

import math

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from pairloom.llm import neighbours, registry
from pairloom.llm.common import table


def brute(rows, asks, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    sizes = [len(v) for v in ok.values()]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), -s)) if sizes else 0
    ok = {i: v for i, v in ok.items() if len(v) == dim}
    out = {}
    for i in filter(asks, ok):
        best = sorted((-float((ok[i] * v).sum()), j) for j, v in ok.items() if j != i)[:k]
        out[i] = [(j, -s) for s, j in best]
    return out


def shown(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({j for j, _ in got.get(q, [])} & {j for j, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, oracle.DATA, "embeddings").select("vec_id", "embedding").collect()]
    got, want = shown(registry.op3_neighbours(spark, oracle.DATA)), brute(rows, lambda i: i % 20 == 0, 20)
    assert recall(got, want) >= 0.97
    vectors = {i: np.array(v, float) for i, v in rows}
    assert all(len(w) == 20 and all(math.isclose(s, vectors[q] @ vectors[j], rel_tol=1e-12) for j, s in w) for q, w in got.items())


@pytest.mark.parametrize("leaf_rows, block", [(100, 50_000), (64, 7)])
def test_many_leaves_and_blocks(spark, leaf_rows, block):
    r = np.random.default_rng(1)
    rows = [(k, (r.normal(size=24) * r.uniform(0.2, 2)).astype(np.float32).tolist()) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = shown(neighbours.nearest(df, F.col("vec_id") % 25 == 0, 10, leaf_rows=leaf_rows, block_queries=block))
    assert recall(got, brute(rows, lambda i: i % 25 == 0, 10)) >= 0.93


def test_hot_vector_ties_and_odd_rows(spark):
    r = np.random.default_rng(2)
    hot = [1.0, 0.0, 0.0, 0.0]
    rows = [(k, hot) for k in range(0, 300, 3)] + [(k, r.normal(size=4).round(1).tolist()) for k in range(1, 300, 3)]
    rows += [(1000, None), (1001, [0.0] * 4), (1002, [1.0, None, 0.0, 0.0]), (1003, [float("nan")] * 4), (1004, [float("inf"), 0.0, 0.0, 0.0]), (1005, [1.0, 2.0]), (None, hot), (1006, [])]
    rows += [(0, hot)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = shown(neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20))
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert {q: [j for j, _ in w] for q, w in got.items()} == {q: [j for j, _ in w] for q, w in want.items()}


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert shown(neighbours.nearest(df, F.col("vec_id") % 20 == 0)) == {0: [(20, 4.0), (3, 1.5)], 20: [(0, 4.0), (3, 1.5)]}
    assert shown(neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0)) == {}
    assert shown(neighbours.nearest(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0)) == {}


def test_chi_square():
    assert math.isclose(neighbours.chi_square_quantile(0.95, 8), 15.507, abs_tol=1e-3)
    assert math.isclose(neighbours.chi_square_quantile(0.5, 2), 2 * math.log(2), abs_tol=1e-9)
