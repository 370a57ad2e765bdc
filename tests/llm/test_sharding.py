from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import oracle
import pytest

from pairloom.llm import oracles, registry, sharding
from pairloom.llm.common import table

COLUMNS = "doc_id long, text string, shard string, size int"


def check(rows, texts, n_shards=24, biggest=0):
    assert len(rows) == len(texts)
    total = sum(len((t or "").encode()) + 8 for _, t in texts)
    load, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n_shards
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i is None, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert all(abs(load[k] - total / n_shards) <= biggest + 0.04 * total / n_shards for k in range(n_shards))


def test_whole_table(spark):
    docs = table(spark, oracle.DATA, "documents")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = registry.op2_sharding(spark, oracle.DATA).collect()
    check(rows, texts, biggest=max(len(t.encode()) + 8 for _, t in texts))
    again = sharding.shard_by_bytes(docs.repartition(5)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_equal_texts_stay_together_until_a_shard_is_full(spark):
    texts = [(k, f"text number {k} " * 9) for k in range(4000)] + [(5000 + k, "small group " * 3) for k in range(20)] + [(9000 + k, "a third of all rows " * 8) for k in range(2000)]
    rows = sharding.shard_by_bytes(spark.createDataFrame(texts, "doc_id long, text string"), 8).collect()
    check(rows, texts, 8, 400)
    shard = {r.doc_id: r.shard for r in rows}
    assert len({shard[5000 + k] for k in range(20)}) == 1
    assert len({shard[9000 + k] for k in range(2000)}) > 1


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (None, "x"), (None, "x"), (3, "é" * 5000), (3, "é" * 5000), (4, "clash")]
    rows = sharding.shard_by_bytes(spark.createDataFrame([(i, t, "s", 1) for i, t in texts], COLUMNS), 4).collect()
    check(rows, texts, 4, 10008)


def test_large_groups_agree_with_the_sql(spark):
    """Forty texts in 150 to 450 copies each, some of them repeated rows, some with null ids: ranges end within texts, and the SQL knows no ranges."""
    for seed in range(3):
        r = random.Random(seed)
        texts = [(None if r.random() < 0.1 else r.randrange(10**5), f"{seed} text {k} " * (k + 3)) for k in range(40) for _ in range(r.randrange(150, 450))]
        texts += [(7, "repeated row " * 20)] * 3000
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
        con = duckdb.connect()
        con.register("documents", docs.toArrow())
        want = con.execute(oracles.sharding()).fetchall()
        got = sharding.shard_by_bytes(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
        assert Counter(map(tuple, got)) == Counter(want)


def test_empty(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], COLUMNS)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64])
def test_binary_search(spark, n):
    from pyspark.sql import functions as F

    splitters = [(k * 10, sharding.LEAST, sharding.LEAST) for k in range(n)]
    rows = spark.range(-5, 700, 3).select(F.col("id"), sharding._range_of(splitters, F.col("id"), F.lit(0), F.lit(0)).alias("p")).collect()
    assert all(r.p == sum(s[0] <= r.id for s in splitters) for r in rows)
