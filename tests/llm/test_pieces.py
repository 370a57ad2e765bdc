from __future__ import annotations

import random

import oracle
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pairloom.llm import pieces, registry
from pairloom.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = pieces.model(PATH)


def every(text):
    """All segmentations as (score, ids of each edge), best first."""
    text = pieces.SPACE + text.replace(" ", pieces.SPACE)

    def rest(i):
        if i == len(text):
            yield 0.0, ()
            return
        for j in range(i + 1, len(text) + 1):
            p = MODEL.pieces.get(text[i:j])
            edge = ((p[0],), p[1]) if p else (tuple(MODEL.spelled[b] for b in text[i].encode()), MODEL.spell_score) if j == i + 1 else None
            if edge:
                for s, tail in rest(j):
                    yield s + edge[1], (edge[0], *tail)

    return sorted(rest(0), key=lambda x: (-x[0], x[1][::-1]))


def applied(ids, edits):
    out = list(ids)
    for at, drop, put in sorted(edits, reverse=True):
        out[at : at + drop] = put
    return out


@pytest.mark.parametrize("seed", range(6))
def test_n_best_against_all_segmentations(seed):
    r = random.Random(seed)
    for _ in range(40):
        text = "".join(r.choice("theraionç éß\n中😀 1") for _ in range(r.randrange(1, 9)))
        want = every(text)[:4]
        ids, score, others = MODEL.encode(text, 4)
        assert [score, *(s for s, _ in others)] == pytest.approx([s for s, _ in want], abs=1e-6)
        got = [ids.tolist(), *(applied(ids, e) for _, e in others)]
        assert len({tuple(g) for g in got}) == len(got) == len(want)
        allowed = {tuple(i for e in w for i in e): s for s, w in every(text)}
        assert [allowed[tuple(g)] for g in got] == pytest.approx([s for s, _ in want], abs=1e-6)
        assert all(MODEL.decode(g) == text for g in got)
        if len(MODEL.parts(text)) == 1:
            assert got == [[i for e in w for i in e] for _, w in want]


def test_parts_are_independent():
    assert all("".join(MODEL.parts(t)) == pieces.SPACE + t.replace(" ", pieces.SPACE) for t in ("a  b\nc", "x", " "))
    joined = {p for p in MODEL.pieces if len(p) > 1 and len(MODEL.parts(p.replace(pieces.SPACE, " "))) > 2}
    assert not joined  # the dummy space is at most one part more


def test_whole_table(spark):
    rows = registry.op8_pieces(spark, oracle.DATA)
    assert rows.count() == table(spark, oracle.DATA, "documents").count()
    assert rows.where("not round_trip").count() == 0 and rows.where("n_pieces = 0").count() == 0


def test_odd_rows(spark):
    texts = [None, "", " ", "same", "same", "x" * 20_000, "word " * 30_000, "\x00\x01", "é\n\n\té"]
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id int, text string, encoded string")
    done = pieces.encode_nbest(docs, PATH)
    rows = {r.doc_id: r for r in done.select("doc_id", "text", "encoded", pieces.decode_column(F.col("encoded.ids"), PATH).alias("back")).collect()}
    assert all((r.text or "") == r.back for r in rows.values())
    assert rows[0].encoded.ids == rows[1].encoded.ids == [] and rows[0].encoded.others == [] and rows[3].encoded == rows[4].encoded
    assert pieces.encode_nbest(docs.limit(0), PATH).count() == 0


def test_small_cache_changes_nothing(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 5
    want = MODEL.encode(text, 4)
    monkeypatch.setattr(pieces, "CACHE_PARTS", 2)
    MODEL.cache.clear()
    got = MODEL.encode(text, 4)
    assert got[0].tolist() == want[0].tolist() and got[1:] == want[1:]


def test_against_the_library_itself():
    """Decoding and piece scores are those of sentencepiece; its own segmentation never has a greater sum."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(8)
    words = "the quick brown fox naïve Straße 東京 😀 x1 ... \n\t foo_bar 12345 ▁ é".split(" ")
    for k in range(300):
        text = " ".join(r.choice(words) for _ in range(r.randrange(1, 12))).replace("▁", "")
        ids, score, others = MODEL.encode(text, 4)
        ids = ids.tolist()
        ways = [(ids, score)] + [(applied(ids, e), s) for s, e in others]
        for way, total in ways:
            assert sp.decode(way) == text == MODEL.decode(way)
            if not any(sp.is_byte(i) for i in way):
                assert total == pytest.approx(sum(sp.get_score(i) for i in way), rel=1e-9, abs=1e-6)
        own = sp.encode(text)
        if not any(sp.is_byte(i) for i in own):
            assert score >= sum(sp.get_score(i) for i in own) - 1e-3
