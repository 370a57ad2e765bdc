from __future__ import annotations

import hashlib
import random
import statistics
import zipfile
import zlib

import oracle
import pytest

from pairloom.llm import media, registry
from pairloom.llm.common import table
from pairloom.session import scratch


def test_whole_table(spark):
    texts = {r.doc_id: r.text.encode() for r in table(spark, oracle.DATA, "documents").collect()}
    rows = registry.op5_media(spark, oracle.DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id]
        want = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        stored = media.to_png(raw)
        assert (r.media_bytes, r.media_sha256, r.feature, r.error) == (len(stored), hashlib.sha256(stored).hexdigest(), media.sample_features(want), None)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 1_000_000])
def test_image_round_trip(n):
    raw = random.Random(n).randbytes(n)
    payload, size = media.from_png(media.to_png(raw))
    assert payload == media.padded(raw) and size == n and len(payload) % 64 == 0 and payload


def test_odd_rows_and_small_ranges(spark):
    texts = [(1, None), (2, ""), (None, "null id"), (3, "same"), (3, "same"), (4, "é" * 300_000)] + [(10 + k, f"text {k} " * k) for k in range(50)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, payload string").repartition(3)
    rows = media.media_columns(docs, rangeBytes=500, batchBytes=1000, media="true").collect()
    assert sorted(((r.key is None, r.key or 0), bytes(r.payload)) for r in rows) == sorted(((i is None, i or 0), media.padded((t or "").encode())) for i, t in texts)
    assert all(media.from_png(bytes(r.media))[0] == bytes(r.payload) for r in rows)


def test_empty(spark):
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_damaged_member_is_a_row_and_others_are_read(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"document {k} " * 20) for k in range(10)], "doc_id long, text string").coalesce(1)
    uri = f"file://{tmp_path}/archives"
    assert media.write_archives(docs, uri) == 10
    path = next((tmp_path / "archives").glob("*.zip"))
    with zipfile.ZipFile(path) as z:
        infos = z.infolist()
    raw = bytearray(path.read_bytes())
    raw[infos[4].header_offset + 70] ^= 0xFF
    path.write_bytes(raw)
    rows = media.read_archives(spark, uri, tries=2).collect()
    assert [r.key for r in rows if r.error] == [4] and [r.payload for r in rows if r.error] == [None]
    assert sorted(r.key for r in rows if r.error is None) == [k for k in range(10) if k != 4]


def test_a_member_is_tried_again():
    reader = media._Reader({"path": "file:///none", "tries": "3"})
    calls = []

    def fetch(store, path, offset, size):
        calls.append(offset)
        if len(calls) < 3:
            raise OSError("not now")
        return media.to_png(b"payload")

    reader._fetch = fetch
    info = zipfile.ZipInfo("0/7.png")
    info.header_offset = 42
    _, payload, n, error = reader._member(None, "x", info)
    assert calls == [42, 42, 42] and payload[:7] == b"payload" and n == 7 and error is None


def test_no_archives(spark):
    assert media.read_archives(spark, scratch(spark, "nothing")).count() == 0


def plain_png(data):
    """(width, samples) of an 8-bit grey PNG by its public format alone: any order of data chunks, all five line filters."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, packed, head = 8, b"", None
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            head = (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), *body[8:])
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    assert kind == b"IEND" and head[2:] == (8, 0, 0, 0, 0)
    width, height = head[:2]
    raw, out, above = zlib.decompress(packed), [], [0] * width
    for y in range(height):
        line, how = list(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)]), raw[y * (width + 1)]
        for x in range(width):
            a, b, c = line[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            paeth = min((a, b, c), key=lambda v: (abs(a + b - c - v), (a, b, c).index(v)))  # noqa: B023
            line[x] = (line[x] + [0, a, b, (a + b) // 2, paeth][how]) % 256
        out += line
        above = line
    return width, bytes(out)


def test_stored_images_by_a_reader_of_their_own(spark):
    """Stored bytes, their digest and the features, none of them through the module's functions."""
    texts = {1: "", 2: "x", 3: "é" * 100, 4: "".join(random.Random(3).choice("abc \n") for _ in range(3000))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in media.media_columns(docs, media="true").collect():
        raw = texts[r.key].encode()
        want = list(raw) + [0] * ((-len(raw)) % 64 if raw else 64)
        assert plain_png(bytes(r.media)) == (64, bytes(want)) and bytes(r.payload) == bytes(want) and r.n_bytes == len(raw)
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        mean = statistics.fmean(want)
        signs = [x >= mean for x in want]
        got = dict(p.split("=") for p in r.feature.split(";"))
        assert float(got["mean"]) == pytest.approx(mean, abs=1e-6) and float(got["var"]) == pytest.approx(statistics.pvariance(want), abs=1e-5)
        assert int(got["cross"]) == sum(a != b for a, b in zip(signs, signs[1:])) and int(got["step"]) == sum((b - a) ** 2 for a, b in zip(want, want[1:]))


def test_damaged_archive_is_a_row_and_others_are_read(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"document {k} " * 20) for k in range(40)], "doc_id long, text string").repartition(4)
    uri = f"file://{tmp_path}/archives"
    media.write_archives(docs, uri)
    broken = sorted((tmp_path / "archives").glob("*.zip"))[1]
    with zipfile.ZipFile(broken) as z:
        lost = len(z.infolist())
    broken.write_bytes(broken.read_bytes()[:-30])
    rows = media.read_archives(spark, uri, tries=2, rangeBytes=300).collect()
    assert [r.archive.rpartition("/")[2] for r in rows if r.error] == [broken.name]
    assert sum(r.error is None for r in rows) == 40 - lost
