from __future__ import annotations

import math
import time

import duckdb
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from pairloom.functions import vectors as V
from pairloom.operators import augment, kvstore, metrics, models, vectors


def test_cosine_of_zero_vector_is_nan(spark):
    rows = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    got = [r[0] for r in rows.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert math.isnan(got[0]) and math.isclose(got[1], 1.0)


def test_masked_pool_without_valid_rows_is_zero(spark):
    rows = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 2, [3.0, 4.0])], "domain string, pos int, vec array<float>")
    assert vectors.pooled(rows, "mean", F.lit(False)).first().embedding == [0.0, 0.0]
    assert vectors.pooled(rows).first().embedding == [2.0, 3.0]


def test_neighbour_mask_shapes(spark):
    one = [("m", i, [j for j in (i - 1, i + 1) if 1 <= j <= 5]) for i in range(1, 6)]
    two = [("n", i, []) for i in (1, 2, 3, 6, 7, 8, 9)]
    masks = {r.domain: np.array(r["mask"]) for r in vectors.neighbour_mask(spark.createDataFrame(one + two, "domain string, i int, nbrs array<int>"), vectors.default_length()).collect()}
    assert masks["m"].shape == (7, 7) and masks["n"].shape == (11, 11)
    assert not masks["m"][0].any() and not masks["m"][6].any() and not masks["n"][4].any() and not masks["n"][5].any()
    assert masks["m"][1].tolist() == [True, False, False, True, True, True, True]


def test_neighbour_masks_of_long_domains(spark):
    r, n = np.random.default_rng(2), 500
    lists = {i: r.integers(-3, n + 40, 4).tolist() for i in range(1, n) if i % 7}
    edges = spark.createDataFrame([("long", i, j) for i, j in lists.items()] + [("few", 1, None), ("few", 2, [1, None, 2]), ("none", 3, [])], "domain string, i int, nbrs array<int>")
    length = F.when(F.col("domain") == "long", n + 2).when(F.col("domain") == "few", 4).otherwise(0)
    for own in (True, False):
        want = {("long", i): "".join("0" if i not in lists or j in lists[i] or (own and i == j) else "1" for j in range(n + 2)) for i in range(n + 2)}
        want |= {("few", 0): "0000", ("few", 1): "0000", ("few", 2): "1001", ("few", 3): "0000"}
        began = time.time()
        rows = {(m.domain, m.row): m.mask for m in vectors.neighbour_mask_rows(edges, length, own).collect()}
        whole = {m.domain: m["mask"] for m in vectors.neighbour_mask(edges, length, own).collect()}
        assert rows == want and whole["none"] == []
        assert {(d, i): "".join(str(int(x)) for x in m) for d, mask in whole.items() for i, m in enumerate(mask)} == want
        assert time.time() - began < 60  # minutes when each cell looked up its row's list


def test_running_size_stops_after_the_limit(spark):
    rows = spark.createDataFrame([("a", k, n) for k, n in enumerate([5, 6, 1])] + [("b", 0, 99), ("b", 1, 1)], "k string, o int, n int")
    assert sorted((r.k, r.o) for r in vectors.within_limit(rows, 10, "n", "k", "o").collect()) == [("a", 0), ("a", 1), ("b", 0)]


def test_auc_by_definition(spark):
    r = np.random.default_rng(0)
    label, pred = r.integers(0, 2, 300), r.integers(0, 20, 300) / 20
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(label, pred, strict=True)], "label int, pred double")
    pos, neg = pred[label == 1], pred[label == 0]
    area = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert math.isclose(metrics.roc_auc(rows, "label", "pred", 5).first()[0], area)
    step = sum((pred[label == 1] == t).sum() / len(pos) * (label[pred >= t] == 1).mean() for t in np.unique(pred))
    assert math.isclose(metrics.pr_auc(rows, "label", "pred", 5).first()[0], step)


def test_auc_without_both_labels_is_null(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, pred double")
    assert metrics.roc_auc(rows, "label", "pred").first()[0] is None
    assert metrics.pr_auc(rows.limit(0), "label", "pred").first()[0] is None


def test_attention_by_loops():
    r = np.random.default_rng(1)
    q, k, v = (r.normal(size=(5, 8)) for _ in range(3))
    shut = np.triu(np.ones((5, 5), bool), 1)
    got = models.attention(q, k, v, 2, shut)
    for h in range(2):
        s = slice(4 * h, 4 * h + 4)
        for i in range(5):
            w = np.array([0.0 if shut[i, j] else math.exp(q[i, s] @ k[j, s] / 2) for j in range(5)])
            assert np.allclose(got[i, s], (w / w.sum()) @ v[:, s])


def test_autoencoder_ignores_padding():
    net = models.SequenceAutoencoder(seed=3)
    tokens = np.array([4, 9, 11, 20])
    a, b = net.encode(tokens), net.encode(np.concatenate([tokens, [0, 0, 0]]))
    assert np.allclose(a, b) and math.isclose(np.linalg.norm(a), 1.0)
    assert net.decode(a, 6).shape == (6, 29)


def test_a_failing_row_is_a_result(spark):
    rows = spark.createDataFrame([("a", [[1.0] * 8]), ("b", [[1.0] * 3]), ("c", None)], "domain string, vecs array<array<double>>")
    got = {r.domain: r for r in models.predict(rows, models.TransformerAggregator(8, 2, 16), "domain", "vecs").collect()}
    assert len(got["a"].embedding) == 8 and got["b"].embedding is None and "Error" in got["b"].error and got["c"].embedding is got["c"].error is None


def test_store_changes(spark):
    log = [("a", 1, "update", "[1]"), ("a", 2, "set", "[2]"), ("b", 1, "set", "[3]"), ("b", 2, "delete", None), ("c", 1, "set", "[4]"), ("c", 2, "update", "[5]"), ("d", 1, "delete", None), ("d", 2, "update", "[6]")]
    folded = kvstore.fold(spark.createDataFrame(log, "id string, seq int, op string, numbers string"))
    assert sorted(map(tuple, folded.collect())) == [("a", "[2]"), ("c", "[5]")]
    after, missing = kvstore.update(folded, spark.createDataFrame([("a", "[9]"), ("z", "[9]")], "id string, numbers string"))
    assert sorted(map(tuple, after.collect())) == [("a", "[9]"), ("c", "[5]")] and [r.id for r in missing.collect()] == ["z"]


def test_augmenters_treat_arrays_alike(spark):
    rows = spark.range(200).select("id", F.sequence(F.lit(0), F.lit(29)).alias("a"), F.sequence(F.lit(0), F.lit(29)).alias("b"))
    cut = augment.remove_fraction(rows, ["a", "b"], "id", 0.2, 10, 7).collect()
    assert all(r.a == r.b and 24 <= len(r.a) <= 29 for r in cut) and len({len(r.a) for r in cut}) > 3
    mixed = augment.permute_regions(rows, ["a", "b"], "id", 0.5, 5, 8).collect()
    assert all(r.a == r.b and sorted(r.a) == list(range(30)) for r in mixed)
    changed = sum(r.a != list(range(30)) for r in mixed)
    assert 30 < changed < 130


def test_weights_go_through_a_file(tmp_path):
    x = np.random.default_rng(0).normal(size=(5, 8))
    for make in (lambda s: models.network("linear", 8, out=3, seed=s), lambda s: models.network("transformer", 8, heads=2, hidden=16, blocks=2, out=6, seed=s)):
        one, two = make(1), make(2)
        assert not np.allclose(one(x), two(x))
        models.save_weights(one, str(tmp_path / "w.npz"))
        assert np.array_equal(models.with_weights(two, models.load_weights(str(tmp_path / "w.npz")))(x), one(x))
    with pytest.raises(ValueError, match="do not fit"):
        models.with_weights(models.network("linear", 8), models.load_weights(str(tmp_path / "w.npz")))
    with pytest.raises(ValueError, match="no network"):
        models.network("other", 8)


def test_top_cosine_in_blocks(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(90, 6))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, k + 1): j for q in range(0, 90, 9) for k, j in enumerate([j for j in np.argsort(-(unit @ unit[q])) if j != q][:5])}
    for block in (None, 3):
        got = {(r["query"], r["rank"]): r["id"] for r in vectors.top_cosine(rows.where("id % 9 = 0"), rows, 5, block).collect()}
        assert got == want


def test_top_cosine_equals_its_sql_on_copies_and_gaps(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(40, 5)).astype(np.float32)[r.integers(0, 40, 300)] * 2.0 ** r.integers(-3, 4, (300, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows[60], rows[61], rows[90], rows[91] = (60, [0.0] * 5), (61, [0.0] * 5), (90, None), (91, None)
    spark.createDataFrame(rows, "id long, embedding array<float>").createOrReplaceTempView("copies")
    con = duckdb.connect()
    con.execute("CREATE TABLE copies (id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO copies VALUES (?, ?)", rows)
    cosine = "list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[])"
    want = con.execute(f"SELECT query, rank, id, c FROM (SELECT q.id AS query, x.id, {cosine} AS c, row_number() OVER (PARTITION BY q.id ORDER BY {cosine} DESC, x.id) AS rank FROM copies q, copies x WHERE q.id % 15 = 0 AND q.id <> x.id) WHERE rank <= 7").fetchall()
    table = spark.table("copies")
    for block in (None, 1, 50):
        assert oracle.rows(["query", "rank", "id", "c"], vectors.top_cosine(table.where("id % 15 = 0"), table, 7, block).collect()) == oracle.rows(["query", "rank", "id", "c"], want)
    named = table.withColumn("id", F.concat(F.lit("v"), F.col("id").cast("string")))
    few = vectors.top_cosine(named.where("id in ('v0', 'v90')"), named.where("id in ('v0', 'v2', 'v10', 'v90')"), 7).collect()
    assert sorted((m["query"], m["id"]) for m in few) == [(q, i) for q in ("v0", "v90") for i in ("v0", "v10", "v2", "v90") if i != q]
    assert [m["id"] for m in few if m["query"] == "v90"] == ["v0", "v10", "v2"] and all((m["cosine"] is None) == ("v90" in (m["query"], m["id"])) for m in few)


def test_top_cosine_of_many_vectors(spark):
    rows = spark.range(12000).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin((F.col("id") % 9000 + 1) * i)).alias("embedding"))
    began = time.time()
    got = vectors.top_cosine(rows.where("id % 2 = 0"), rows, 3).collect()
    assert len(got) == 18000 and time.time() - began < 60  # minutes when each pair was computed by array functions
    assert {m["query"]: m["id"] for m in got if m["rank"] == 1 and m["query"] < 3000} == {k: k + 9000 for k in range(0, 3000, 2)}
