from __future__ import annotations

import itertools
import random

import numpy as np
import oracle
import pytest
import xxhash

from pyspark.sql import functions as F

from pairloom.llm import components, registry, simhash
from pairloom.llm.common import table


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows):
    """doc_id -> (fingerprint, component) by comparing all pairs."""
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    x = np.array([f for _, f in fps], np.uint64)
    for k in range(len(x)):
        for m in np.flatnonzero(np.bitwise_count(x[k] ^ x) <= 2):
            a, b = find(k), find(int(m))
            parent[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i is None, i or 0, f"{f:016x}", least.get(find(k), -1)) for k, (i, f) in enumerate(fps))


def shown(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in rows)


def test_whole_table(spark):
    docs = table(spark, oracle.DATA, "documents").select("doc_id", "text")
    assert shown(registry.op6_simhash(spark, oracle.DATA).collect()) == brute([tuple(r) for r in docs.collect()])


def test_chains_copies_and_odd_rows(spark):
    r = random.Random(3)
    base = " ".join(r.choice("alpha beta gamma delta epsilon zeta".split()) + str(r.randrange(50)) for _ in range(900)).split()
    rows = []
    for k in range(60):  # each differs from the one before in a word, so that links form chains
        base = [*base]
        base[r.randrange(len(base))] = f"w{k}"
        rows.append((100 - k, " ".join(base)))
    rows += [(500 + k, "the same short text") for k in range(30)] + [(1, None), (2, ""), (3, " \t\n"), (None, "null id"), (None, ""), (7, "one two"), (7, "one two"), (8, "ÀÉ upper CASE stays É"), (9, "no break")]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, fp long, component_id string")
    got = shown(simhash.near_duplicates(docs).collect())
    assert got == brute(rows)
    assert len({g[3] for g in got}) < len(rows) - 40


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, rows of one id in different groups, and null ids: by row, not by id."""
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "quite another text of some words"), (2, "quite another text of some words"), (None, "a b c d e f g h"), (None, "only here without an id"), (5, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, row string, fp int").withColumn("nothing", F.lit(None))
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("1", rows[0][1]), ("2", rows[2][1]), ("None", rows[5][1]), ("4", "")])
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("flips", [0, 1, 2])
def test_close_fingerprints_meet_once(flips):
    r = np.random.default_rng(5)
    for _ in range(40):
        x = int(r.integers(0, 2**64, dtype=np.uint64))
        y = x
        for b in r.choice(64, flips, replace=False):
            y ^= 1 << int(b)
        pair = np.array([x, y], np.uint64).view(np.int64)
        at, anchor, home = simhash.anchors(pair)
        homes = {int(k): int(a) for k, a, h in zip(at, anchor, home, strict=True) if h}
        assert len(homes) == 2
        for k in (0, 1):
            assert sum(1 for i, a in zip(at, anchor, strict=True) if i == 1 - k and a == homes[k]) == 1


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_components_of_a_path_a_star_and_noise(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(300)} | {6000: 6000, 6001: 6000}


def test_covering_radius():
    s = simhash._syndromes()
    weights = [w for w in range(4) for _ in itertools.combinations(range(23), w)]
    patterns = [sum(1 << i for i in c) for w in range(4) for c in itertools.combinations(range(23), w)]
    assert len(patterns) == len(weights) == 2048 == len({int(s[p]) for p in patterns})
