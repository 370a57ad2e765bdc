from __future__ import annotations

import numpy as np
import oracle
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pairloom.llm import packing, registry, tokens
from pairloom.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, window=1024, spare=1):
    """Every id of every document in one piece, sequences without gaps, all full but `spare`."""
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    ids = {}
    for i, t in texts:
        ids.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        want = []
        for doc in ids[i]:
            assert any(n == len(doc) for *_, n in own)
            want.append(len(doc))
        assert sum(length for _, length, _, _ in own) == sum(want)
        if len(ids[i]) == 1:
            doc, at = np.array(ids[i][0]), 0
            for start, length, crc, n in sorted(own):
                assert start == at and length > 0 and n == len(doc) and crc == packing.ids_crc32(doc[start : start + length])
                at += length
            assert at == len(doc)
    lengths = []
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
        lengths.append(at)
    assert sum(n < window for n in lengths) <= spare


def test_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in table(spark, oracle.DATA, "documents").collect()]
    check(registry.op10_packing(spark, oracle.DATA).collect(), texts)


def test_odd_rows_and_many_shards(spark):
    texts = [(1, None), (2, ""), (3, "é" * 9000), (4, "word " * 5000), (5, "<|endoftext|> stays text"), (6, "same " * 40), (6, "same " * 40), (None, "null id"), (8, "x" * 30_000)]
    texts += [(100 + k, f"document {k % 7} " * (k % 90)) for k in range(300)]
    docs = spark.createDataFrame([(i, t, "s", 7) for i, t in texts], "doc_id long, text string, shard string, length int")
    check(packing.pack(docs, PATH, docs_per_shard=40).collect(), texts, spare=8)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_ids_equal_those_of_the_other_library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    own = tokens.byte_bpe(PATH)
    texts = ["", " ", "  a\n\n b\t", "don't we'll I'M", "ñandú 中文 😀👍🏽", "a" * 3000, "١٢٣ x²", "\x00\x7f 　", "<|endoftext|>", "tabs\t\t\tand   spaces   "]
    assert [own.encode_ordinary(t) for t in texts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_bm25_scores_by_definition():
    r = np.random.default_rng(0)
    docs = [r.integers(0, 30, r.integers(1, 25)) for _ in range(12)]
    index = packing.Bm25(docs, query_terms=1000)
    mean = np.mean([len(d) for d in docs])
    for q in range(12):
        want = np.zeros(12)
        for t in set(docs[q].tolist()):
            df = sum(t in d for d in docs)
            idf = np.log1p((12 - df + 0.5) / (df + 0.5))
            for k, d in enumerate(docs):
                tf = (d == t).sum()
                if tf:
                    want[k] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        assert index.scores(q) == pytest.approx(want)


def test_windows_take_similar_documents():
    r = np.random.default_rng(1)
    docs = [r.integers(1000 * (k % 4), 1000 * (k % 4) + 50, 200) for k in range(80)]
    windows = packing.fill_windows(docs, 800)
    same = [len({d % 4 for d, _, _ in w}) == 1 for w in windows]
    assert np.mean(same) > 0.8 and sum(n for w in windows for *_, n in w) == 80 * 200


def test_statistics_are_of_all_documents(spark):
    r = np.random.default_rng(2)
    texts = [(k, " ".join(r.choice(["ash", "birch", "cedar", "dogwood", "elm", "fir"], r.integers(0, 9)))) for k in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    rows, of = packing.statistics(docs.mapInArrow(packing._tokenise(PATH, 1024), packing.TOKENISED))
    ids = [tokens.byte_bpe(PATH).encode_ordinary(t) + [0] for _, t in texts]
    assert (rows, of.n, of.mean) == (50, 50, np.mean([len(d) for d in ids]))
    assert of.df.tolist() == [sum(t in d for d in ids) for t in range(len(of.df))] and of.df[0] == 50
    index = packing.Bm25([np.array(d) for d in ids[:3]], of=of)
    all_docs = packing.Bm25([np.array(d) for d in ids], query_terms=1000)
    assert index.scores(1) == pytest.approx(all_docs.scores(1)[:3])


def test_related_documents_meet_in_a_shard(spark):
    """Forty kinds of documents over forty shards: dealt by a hash of the row, one pair in forty of a kind would meet."""
    r = np.random.default_rng(3)
    words = [["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)] for _ in range(40)]
    texts = [(k, " ".join([*r.permutation(words[k % 40]), str(k)])) for k in range(800)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH, docs_per_shard=20).collect()
    shard = {r.doc_id: r.sequence_id >> 32 for r in rows}
    pairs = [(a, b) for a in range(800) for b in range(a + 40, 800, 40)]
    assert len(set(shard.values())) > 20 and np.mean([shard[a] == shard[b] for a, b in pairs]) > 0.25


def test_windows_are_filled_with_neighbours_to_the_end():
    """Short documents, of which a window holds far more than 32: all of a window's are of one kind while any is left."""
    r = np.random.default_rng(4)
    docs = [r.integers(1000 * (k % 2), 1000 * (k % 2) + 50, 10) for k in range(800)]
    windows = packing.fill_windows(docs, 1000)
    assert [len({d % 2 for d, _, _ in w}) for w in windows[:3]] == [1, 1, 1] and len(windows) == 8
    assert list(packing.ranked(np.array([0.0, 2, 5, 2, 1]), head=1)) == [2, 1, 3, 4]


def test_all_terms_of_a_seed_are_asked():
    """Fifty rare terms are stronger than the one that a second document shares."""
    docs = [np.array([*range(100, 150), 7]), np.array([7, 8]), *[np.array([7, 9])] * 3, *[np.array([9, 10])] * 20]
    assert packing.Bm25(docs).scores(0)[1] > 0


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 1_000_000 + "z", "a" + " " * 4096 + "x" + "　" * 4095 + " y" + "\t" * 4097, "!" * 100_000, "ab" * 100_000])
def test_ids_of_long_runs(text):
    tokenizer = Tokenizer.from_file(PATH)
    assert tokens.encode(tokens.byte_bpe(PATH), text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_very_long_white_space_in_a_table(spark):
    texts = [(1, "a" + " " * 1_500_000 + "b"), (2, "\n" * 1_000_001), (3, "x")]
    check(packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH).collect(), texts)
