from __future__ import annotations

import random

import numpy as np
import oracle

from pairloom.llm import fmindex, registry, substrings
from pairloom.llm.common import table


def brute(rows, window):
    """doc -> (n_words, n_removed, kept) with every window in a dict."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < rank(i):
                gone.update(range(k, k + window))
        out.append((rank(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def shown(df, column="stripped"):
    rows = df.select("doc_id", f"{column}.*").collect()
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_removed, r.kept) for r in rows)


def test_whole_table(spark):
    docs = table(spark, oracle.DATA, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, 50)
    assert shown(substrings.strip_repeats(docs)) == want
    import hashlib

    digests = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in registry.op4_substring_dedup(spark, oracle.DATA).collect())
    assert digests == [(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for (_, i), n, m, k in want]
    assert sum(d[2] for d in digests) > 0


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("a b c d e f g h".split()) + str(r.randrange(4))
    passages = [[word() for _ in range(r.randrange(10, 40))] for _ in range(12)]
    rows = []
    for k in range(120):
        text = []
        for _ in range(r.randrange(0, 6)):
            text += r.choice(passages) if r.random() < 0.5 else [word() for _ in range(r.randrange(1, 30))]
        rows.append((r.randrange(60) if r.random() < 0.9 else None, " ".join(text)))
    return rows


def test_small_windows_many_passages_and_repeated_ids(spark):
    for seed, options in ((1, {}), (2, {"words_per_shard": 200}), (3, {"crowd": 0, "words_per_shard": 100}), (4, {"crowd": 2})):
        rows = corpus(seed) + [(3, None), (4, ""), (5, "\t \n"), (7, "x y z"), (7, "x y z")]
        docs = spark.createDataFrame([(i, t, 1, "old") for i, t in rows], "doc_id long, text string, row long, stripped string")
        got = substrings.strip_repeats(docs, window=10, **options)
        assert got.columns == ["doc_id", "text", "row", "stripped"]
        assert shown(got) == brute(rows, 10)


def test_exactly_one_window_and_one_less(spark):
    shared = [f"s{k}" for k in range(50)]
    rows = [(1, " ".join(["p", *shared, "q"])), (2, " ".join(["r", *shared, "t"])), (3, " ".join(["u", *shared[:49], "v"])), (0, "short " * 49)]
    assert shown(substrings.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 50)


def test_a_common_passage_in_a_third_of_rows(spark):
    r = random.Random(9)
    common = " ".join(f"c{k}" for k in range(70))
    rows = [(k, f"{r.random()} {common} {r.random()} {common}" if k % 3 == 0 else " ".join(str(r.random()) for _ in range(60))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(substrings.strip_repeats(docs, crowd=20, words_per_shard=500)) == brute(rows, 50)


def test_empty(spark):
    assert substrings.strip_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wavelet_ranks():
    r = np.random.default_rng(0)
    for n, symbols in ((1, 2), (63, 3), (64, 5), (65, 9), (1000, 300)):
        text = r.integers(0, symbols, n)
        tree = fmindex.WaveletMatrix(text, symbols)
        c, i, j = r.integers(0, symbols, 50), r.integers(0, n + 1, 50), r.integers(0, n + 1, 50)
        a, b, _ = tree.narrow(c.astype(np.uint32), i, j)
        assert a.tolist() == [int((text[:k] == s).sum()) for s, k in zip(c, i, strict=True)]
        assert b.tolist() == [int((text[:k] == s).sum()) for s, k in zip(c, j, strict=True)]


def test_windows_of_texts_that_are_not_indexed():
    r = random.Random(2)
    texts = [np.array([r.randrange(1, 4) for _ in range(r.randrange(1, 40))]) for _ in range(25)]
    index = fmindex.FmIndex(texts, 5, 6, np.arange(100, 125))
    queries = [np.array([r.randrange(1, 5) for _ in range(r.randrange(0, 60))], np.int64) for _ in range(40)]
    held = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - 5):
            held.setdefault(tuple(t[p : p + 6]), 100 + k)
    for q, found in zip(queries, index.least_owner(queries), strict=True):
        assert found.tolist() == [held.get(tuple(q[p : p + 6]), -1) for p in range(len(q) - 5)]


def test_repeated_rows_cost_their_number_only(spark):
    """2,000 rows of one document beside another, with and without a doc_id: the segments searched do not multiply."""
    r = random.Random(4)
    text = " ".join(f"w{r.randrange(9000)}" for _ in range(400))
    rows = [(1, text)] + [(5, text)] * 2000 + [(None, text)] * 2000 + [(None, "x " + text)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    numbered = docs.selectExpr("monotonically_increasing_id() AS row", f"coalesce(doc_id, {substrings.LAST}) AS id", "text")
    found = substrings.repeated_windows(substrings.spool(numbered, "test")).selectExpr("size(found) AS n").collect()
    assert len(found) == 4005 and max(f.n for f in found) < 60
    got = shown(substrings.strip_repeats(docs))
    assert [g[1:] for g in got if g[0] != (False, 1)].count((400, 400, "")) == 4000
    assert sum(g[1:] == (401, 400, "x") for g in got) == 5


def test_columns_that_are_void_or_clash(spark):
    docs = spark.sql("SELECT * FROM VALUES (1L, 'a b c', 'r', 1, NULL), (2L, 'a b c', 's', 2, NULL) AS t(doc_id, text, row, found, id)")
    got = substrings.strip_repeats(docs, window=2).orderBy("doc_id").collect()
    assert [(g.doc_id, g.text, g.row, g.found, g.id, g.stripped.kept) for g in got] == [(1, "a b c", "r", 1, None, "a b c"), (2, "a b c", "s", 2, None, "")]
