"""Queries without SQL take all rows of their tables, whole."""

from __future__ import annotations

import re

import numpy as np
import oracle
import pytest

from pairloom.operators import models, sequences
from pairloom.plans import registry
from pairloom.plans import views as v

QUERIES = registry.queries()


def test_identities_are_of_all_whole_texts(spark):
    items = {f"B{r.item_id:04d}": (r.item_id, re.sub("[^A-Za-z]", "", r.text).upper().translate(str.maketrans("JOU", "LKC"))) for r in v.table(spark, oracle.DATA, "benchmark").collect()}
    scores, n = sequences.substitution(), len(items)
    cross = {(r.seq1, r.seq2): r.sequence_identity for r in QUERIES["u1_cross_identity"](spark, oracle.DATA).collect()}
    assert set(cross) == {(a, b) for a in items for b in items if items[a][0] % 50 == 0}
    for a, b in sorted(cross)[::97]:
        assert cross[a, b] == pytest.approx(sequences.identity(items[a][1], items[b][1], scores))
    every = {(r.seq1, r.seq2): r.sequence_identity for r in QUERIES["u1_alignment_identity"](spark, oracle.DATA).collect()}
    assert set(every) == {(a, b) for a in items for b in items if a < b}
    for a, b in sorted(every)[::1999]:
        assert every[a, b] == pytest.approx(sequences.identity(items[a][1], items[b][1], scores))
    assert sum(r.pairs for r in QUERIES["w11_equal_pair_rows"](spark, oracle.DATA).collect()) == n * (n - 1) // 2


def test_autoencoder_takes_every_item(spark):
    got = QUERIES["u5_sequence_autoencoder"](spark, oracle.DATA).collect()
    assert len(got) == v.table(spark, oracle.DATA, "benchmark").count() and all(r.error is None for r in got)


def test_networks_see_every_residue(spark):
    domains = {}
    for r in v.residues(spark, oracle.DATA).orderBy("domain", "pos").collect():
        domains.setdefault(r.domain, []).append(r.vec)
    plain, masked = models.TransformerAggregator(64, seed=1), models.TransformerAggregator(64, blocks=1, seed=2)
    for name in ("u3_transformer_pool", "u3_masked_transformer_pool"):
        got = {r.domain: r.embedding for r in QUERIES[name](spark, oracle.DATA).collect()}
        assert set(got) == set(domains)
        for domain, vecs in domains.items():
            n = len(vecs)
            shut = np.array([[j not in (i, i - 2, i + 1, i + 5) for j in range(n)] for i in range(n)])
            x = np.array(vecs)
            assert got[domain] == pytest.approx((masked(x, shut) if "masked" in name else plain(x)).tolist(), rel=1e-6, abs=1e-6)


def test_errors_are_isolated_in_whole_domains(spark, monkeypatch):
    seen, call = [], models.predict
    monkeypatch.setattr(models, "predict", lambda rows, *a, **b: seen.append({r.domain: None if r.vecs is None else len(r.vecs) for r in rows.collect()}) or call(rows, *a, **b))
    sizes = {r.domain: r["count"] for r in v.residues(spark, oracle.DATA).groupBy("domain").count().collect()}
    for name in ("u16_failing_rows", "t6_isolated_errors"):
        QUERIES[name](spark, oracle.DATA)
        got = seen.pop()
        assert {k: n for k, n in got.items() if k not in "35"} == {k: n for k, n in sizes.items() if k not in "35"} and got["5"] == 0


def test_pdb_serials_of_large_tables(spark, tmp_path):
    for name in oracle.TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"{oracle.DATA}/{name}.parquet") if name != "embeddings" else None
    rows = v.table(spark, oracle.DATA, "embeddings")
    rows.withColumn("vec_id", rows.vec_id + 99_800).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert oracle.differences(QUERIES["s13_pdb_atoms"], registry.oracle_sql()["s13_pdb_atoms"], spark, str(tmp_path)) == ""
