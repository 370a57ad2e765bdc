"""The pipeline against plain versions of its stages, each on its own input."""

from __future__ import annotations

import corpus_pipeline
import oracle
from test_packing import check as check_packing
from test_simhash import brute as brute_groups
from test_substrings import brute as brute_repeats

from pairloom.llm import quality
from pairloom.llm.common import spool, table


def test_stages(spark):
    docs, columns = table(spark, oracle.DATA, "documents"), ["doc_id", "text", "lang", "source", "n_chars"]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "substring_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = spool(stage(spark, docs, oracle.DATA), f"test-{name}")
        before, after = ([tuple(r) for r in d.select("doc_id", "text").collect()] for d in (docs, out)) if name != "packing" else (None, None)
        if name == "quality":
            scores = quality.score(docs, table(spark, oracle.DATA, "labels")).collect()
            assert sorted(after) == sorted((r.doc_id, r.text) for r in scores if r.score >= 0.3)
            assert 0 < len(after) < len(before)
        elif name == "near_dedup":
            keep = {i for _, i, _, least in brute_groups(before) if i == least}
            assert sorted(after) == sorted((i, t) for i, t in before if i in keep)
            assert len(after) < len(before)
        elif name == "substring_dedup":
            old = dict(before)
            want = {i: kept if gone else old[i] for (_, i), _, gone, kept in brute_repeats(before, 50)}
            assert dict(after) == want and all(r.n_chars == len(r.text) for r in out.collect())
            assert want != old
        else:
            check_packing(out.collect(), [(r.doc_id, r.text) for r in docs.collect()])
        if name != "packing":
            assert out.columns == columns
            docs = out


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, oracle.DATA)
    assert rows.count() > 0 and "sequence_id" in rows.columns and corpus_pipeline.ORACLE_SQL is None


def test_stages_with_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "x", "y", 0), (None, "no id", None, "y", 5), (3, "plain words stand here", None, None, 22), (3, "plain words stand here", None, None, 22)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = spool(stage(spark, docs, oracle.DATA), f"odd-{name}")
        assert docs.count() >= 0
