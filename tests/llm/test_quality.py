from __future__ import annotations

import math
import os
import zlib
from collections import Counter

import numpy as np
import oracle
import pytest

from pairloom.llm import quality, registry
from pairloom.llm.common import table

BIG = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no larger table")
def test_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in table(spark, BIG, "labels").collect()}
    rows = registry.op9_quality(spark, BIG).collect()
    assert len(rows) == table(spark, BIG, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(labels[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([h for h in held if h[0] == v] for v in (1, 0))
    assert np.mean([p for _, p, _ in good]) > 0.985 and np.mean([p for _, p, _ in bad]) < 0.15
    assert np.mean([g[2] > b[2] for g in good for b in bad]) > 0.98


def test_labels_of_held_out_rows_and_other_columns_are_not_read(spark):
    docs, labels = table(spark, oracle.DATA, "documents"), table(spark, oracle.DATA, "labels")
    from pyspark.sql import functions as F

    a = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    b = {r.doc_id: r.score for r in quality.score(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), turned).collect()}
    assert a == b


def test_odd_rows(spark):
    good, bad = "Some plain words stand here, and others follow them. " * 4, "A!! B!! C!! D$$ E### " * 10
    rows = [(k, good if k % 3 else bad) for k in range(200)] + [(900, None), (901, ""), (None, good), (902, "w " * 100_000), (903, "\x00\n\t")]
    docs = spark.createDataFrame([(i, t, 5.0) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)] + [(None, 1), (7, None), (99999, 1), (1, 1)], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text or "", r.score) == r.score
    assert by_text[good] > 0.5 > by_text[bad]
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels).count() == 0


def test_prior_from_positives_alone():
    r = np.random.default_rng(0)
    positive, unlabelled = r.normal(2, 1, (1500, 3)), np.concatenate([r.normal(2, 1, (1400, 3)), r.normal(-2, 1, (600, 3))])
    assert abs(quality.estimate_prior(positive, unlabelled) - 0.7) < 0.06


def test_risk_and_its_slopes_against_sums_written_out():
    r = np.random.default_rng(5)
    for prior, shift in ((0.3, 0.0), (0.8, 0.0), (0.9, 6.0)):
        p, u = r.normal(1 + shift, 1, 7), r.normal(0, 2, 11)
        positive = sum(math.log(1 + math.exp(-z)) for z in p) / 7
        wrong = sum(math.log(1 + math.exp(z)) for z in u) / 11 - prior * sum(math.log(1 + math.exp(z)) for z in p) / 7
        assert quality.pu_risk(p, u, prior) == pytest.approx(prior * positive + max(0, wrong))
        z, eps = np.concatenate([p, u]), 1e-6
        whole = (lambda z: quality.pu_risk(z[:7], z[7:], prior)) if wrong >= 0 else (lambda z: prior * np.logaddexp(0, z[:7]).mean() - np.logaddexp(0, z[7:]).mean())  # noqa: B023
        numeric = [(whole(z + eps * (np.arange(18) == k)) - whole(z - eps * (np.arange(18) == k))) / (2 * eps) for k in range(18)]
        assert quality.pu_slopes(z, 7, prior) == pytest.approx(numeric, abs=1e-6)


def test_scores_against_the_network_written_out():
    """Margins of both kinds of inputs, summed one by one; gradients against differences."""
    r = np.random.default_rng(6)
    net, x = quality.Network(5, 3, 1, n_deep=3), r.normal(size=(4, 5)).astype(np.float32)
    net.p[3] = r.normal(size=2).astype(np.float32)
    w, b, v, u, c = net.p
    want = [sum(v[j] * math.tanh(sum(row[i] * w[i, j] for i in range(3)) + b[j]) for j in range(3)) + row[3] * u[0] + row[4] * u[1] + c[0] for row in x]
    assert net.margin(x) == pytest.approx(want, abs=1e-5)
    net.p = [p.astype(np.float64) for p in net.p]
    for k, g in enumerate(net.gradient(x, np.ones(4))):
        for at in np.ndindex(g.shape):
            net.p[k][at] += 1e-5
            up = net.margin(x).sum()
            net.p[k][at] -= 2e-5
            assert g[at] == pytest.approx((up - net.margin(x).sum()) / 2e-5, abs=1e-4)
            net.p[k][at] += 1e-5


def test_hashed_terms_by_hand():
    text = "one two one\nthree"
    words = text.encode().split()
    terms = [zlib.crc32(w) for w in words] + [(zlib.crc32(a) * 0x85EBCA6B & 0xFFFFFFFF) ^ zlib.crc32(b) for a, b in zip(words, words[1:])]
    terms += [a << 16 | b << 8 | c for a, b, c in zip(text.encode(), text.encode()[1:], text.encode()[2:])]
    counts = Counter((t * 0x9E3779B1 & 0xFFFFFFFF) >> 23 for t in terms)
    want = np.array([math.log(1 + counts[k]) for k in range(quality.N_HASHED)])
    assert quality.features(text)[quality.N_SHARES :] == pytest.approx(want / np.linalg.norm(want), abs=1e-3)


def test_non_negative_risk_separates():
    r = np.random.default_rng(1)
    positive, unlabelled = r.normal(1.5, 1, (800, 4)), np.concatenate([r.normal(1.5, 1, (700, 4)), r.normal(-1.5, 1, (300, 4))])
    net = quality.fit_pu(positive, unlabelled, 0.7)
    z = net.margin(unlabelled) > 0
    assert z[:700].mean() > 0.97 and z[700:].mean() < 0.05
