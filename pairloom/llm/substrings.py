"""Substring dedup: repeated word windows across documents, found with FM-indexes over shards.

1. Every document is cut at minimisers (the least hash of 8 words in each 50-word window): neighbouring
   windows with the same minimiser are one segment. Equal windows have equal minimisers, so a window can
   only recur among segments of its own minimiser.
2. Minimisers of a single document are done with. One copy of each different segment of the others is fetched
   and dealt to shards by minimiser. Only a minimiser with very many different segments (the edges of a passage
   that a large part of all documents holds) would be too much for one shard: its windows are summed up by
   their own 128-bit hashes, which deals them evenly, and join step 4.
3. Each shard builds an FM-index of its segments and streams them through it: matching statistics capped at
   50 words give the rows of each window, and these the least doc_id that holds it.
4. Each occurrence of a segment compares these with its own doc_id; covered words leave the document.

Work grows with the text, and with the length of what is shared; no pair of documents is formed. Copies of a
segment, however many, are one row in step 2's partial sums and one text in step 3.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from pairloom.llm.common import bounded_batches, discard, spool
from pairloom.llm.fmindex import FmIndex

GRAM = 8
LAST = 2**63 - 1


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def segments(words: list[bytes], window: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, content hash, first word, number of windows) of each segment of a document."""
    n, gram = len(words), min(GRAM, window)
    if n < window:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = _hashes(words)
    grams = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[j : n - gram + 1 + j]
    grams = _mix(grams)
    at = sliding_window_view(grams, window - gram + 1).argmin(axis=1) + np.arange(n - window + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, len(at)))
    raw = memoryview(h.tobytes())
    content = np.fromiter((xxh64_intdigest(raw[8 * a : 8 * (a + c + window - 1)], 1) for a, c in zip(first.tolist(), count.tolist(), strict=True)), np.uint64, len(first))
    return grams[at[first]], content, first, count


CUT = "row long, id long, minimiser long, content long, place long, more array<long>"


def _cut(window: int):
    """Documents to their different segments: where each stands first, and where else (null if nowhere)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, kept, more = [], [], []
            for k, text in enumerate(b.column(2)):
                keys, content, first, count = segments((text.as_py() or "").encode().split(), window)
                place = first << 16 | count
                order = np.lexsort((place, content, keys))
                new = np.flatnonzero(np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (content[order][1:] != content[order][:-1])])) if len(order) else order
                ends = np.append(new, len(order))[1:]
                owner.append(np.full(len(new), k))
                kept.append((keys[order[new]], content[order[new]], place[order[new]]))
                more += [place[order[x + 1 : y]] if y > x + 1 else None for x, y in zip(new.tolist(), ends.tolist(), strict=True)]
            owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
            keys, content, place = (np.concatenate([p[k] for p in kept]) if kept else np.empty(0, np.uint64) for k in range(3))
            rows, ids = b.column(0).to_numpy()[owner], b.column(1).to_numpy()[owner]
            columns = [rows, ids, keys.view(np.int64), content.view(np.int64), place.view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(more, pa.list_(pa.int64()))], names=["row", "id", "minimiser", "content", "place", "more"])

    return run


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _each(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[bytes]]]:
    """(segment, its document's words) of a batch of (wanted, text)."""
    for wanted, text in zip(batch.column(0), batch.column(1), strict=True):
        words = text.as_py().encode().split()
        for s in wanted.as_py():
            yield s, words


def _fetch(window: int, shards: int):
    """(wanted segments, text) to their words, dealt to shards by minimiser."""
    kinds = {"shard": pa.int64(), "minimiser": pa.int64(), "content": pa.int64(), "least": pa.int64(), "piece": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, words in _each(b):
                first, count = s["place"] >> 16, s["place"] & 0xFFFF
                out.append((s["minimiser"] % shards, s["minimiser"], s["content"], s["least"], b" ".join(words[first : first + count + window - 1])))
            yield _batch(out, kinds)

    return run


def _windows(window: int):
    """(wanted segments, text) to each of their windows by two hashes of its words."""
    kinds = {"minimiser": pa.int64(), "content": pa.int64(), "skip": pa.int32(), "least": pa.int64(), "h1": pa.int64(), "h2": pa.int64()}
    signed = lambda h: h - (h >> 63 << 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, words in _each(b):
                first, count = s["place"] >> 16, s["place"] & 0xFFFF
                for k in range(count):
                    text = b" ".join(words[first + k : first + k + window])
                    out.append((s["minimiser"], s["content"], k, s["least"], signed(xxh64_intdigest(text, 1)), signed(xxh64_intdigest(text, 2))))
            yield _batch(out, kinds)

    return run


def _search(window: int):
    """One shard: index its segments, stream them through the index, return the least owner of every window."""

    def run(table: pa.Table) -> pa.Table:
        ids: dict[bytes, int] = {}
        number = itertools.count(1)
        texts = []
        for piece in table.column("piece").to_pylist():
            words = piece.split()
            texts.append(np.fromiter((ids.get(w) or ids.setdefault(w, next(number)) for w in words), np.int64, len(words)))
        found = FmIndex(texts, len(ids) + 1, window, table.column("least").to_numpy()).least_owner(texts)
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        leasts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found), pa.int64()))
        return pa.table({"minimiser": table.column("minimiser"), "content": table.column("content"), "skip": pa.array(np.zeros(len(found)), pa.int32()), "leasts": leasts})

    return run


def repeated_windows(own: DataFrame, window: int = 50, words_per_shard: int = 1 << 18, crowd: int = 2000) -> DataFrame:
    """(row, found) of the rows (row, id, text, ...), row being unique and id not null: of each row with any, its segments that
    have windows which also start in a row of smaller id, as array<struct<place, more, skip, hits>>: the window at
    (place >> 16) + skip + k does if hits[k], and likewise at the places in more.
    """
    carried = [F.col(c) for c in own.columns if c not in ("row", "id", "text")]
    cut = spool(own.where("text is not null").select("row", "id", "text").mapInArrow(_cut(window), CUT), "segments")

    # sums and joins by minimiser: sums are combined before the shuffle and joins split hot keys, so no task needs all of one
    shared = cut.groupBy("minimiser").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select(F.col("minimiser").alias("m_"))
    found = spool(cut.join(shared, F.col("minimiser") == F.col("m_"), "left_semi"), "shared")
    discard(cut)
    kinds = found.groupBy("minimiser", "content").agg(F.min("id").alias("least"), F.min("row").alias("row"), F.min_by("place", "row").alias("place"))
    crowds = kinds.groupBy("minimiser").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(F.col("minimiser").alias("m_"), F.lit(True).alias("c_"))
    kinds = kinds.join(crowds, F.col("minimiser") == F.col("m_"), "left").select("minimiser", "content", "least", "row", "place", F.coalesce("c_", F.lit(False)).alias("crowded"))
    kinds = spool(kinds, "kinds")
    words = F.when(~F.col("crowded"), F.col("place").bitwiseAND(0xFFFF) + window)
    sizes = kinds.agg(F.sum(words).alias("words"), F.count_if("crowded").alias("crowded")).first()
    shards = -(-(sizes.words or 0) // words_per_shard) or 1

    def fetched(which: DataFrame, cut, schema: str) -> DataFrame:
        # the hash of the other columns keeps them in the shuffle, which is then the same as that of strip_repeats and is written once
        wanted = which.groupBy(F.col("row").alias("at")).agg(F.collect_list(F.struct("minimiser", "content", "least", "place")).alias("wanted"))
        return own.join(wanted, F.col("row") == F.col("at")).select("wanted", "text", F.xxhash64(F.lit(0), *carried)).mapInArrow(cut, schema)

    pieces = fetched(kinds.where("not crowded"), _fetch(window, shards), "shard long, minimiser long, content long, least long, piece binary")
    leasts = pieces.groupBy("shard").applyInArrow(_search(window), "minimiser long, content long, skip int, leasts array<long>")
    if sizes.crowded:
        single = fetched(kinds.where("crowded"), _windows(window), "minimiser long, content long, skip int, least long, h1 long, h2 long")
        by_hash = single.groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.min("least").alias("first"))
        held = single.join(by_hash, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
        leasts = leasts.unionByName(held.select("minimiser", "content", "skip", F.array("first").alias("leasts")))
    leasts = leasts.select(F.col("minimiser").alias("m_"), F.col("content").alias("c_"), "skip", "leasts", F.array_min("leasts").alias("least"))
    match = (F.col("minimiser") == F.col("m_")) & (F.col("content") == F.col("c_")) & (F.col("id") > F.col("least"))
    hits = F.transform("leasts", lambda x: x < F.col("id")).alias("hits")
    later = found.join(leasts, match).select("row", F.struct("place", "more", "skip", hits).alias("f"))
    return later.groupBy("row").agg(F.collect_list("f").alias("found"))


STRIPPED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def _ranges(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ... in one array."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _hit_windows(found: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(document of the batch, first word) of every window that is to go."""
    docs = np.repeat(np.arange(len(found)), found.value_lengths().fill_null(0).to_numpy())
    segments = found.flatten()
    more, hits = segments.field("more"), segments.field("hits")
    n_more = more.value_lengths().fill_null(0).to_numpy()
    each = np.arange(len(segments))
    segment = np.concatenate([each, np.repeat(each, n_more)])  # of each occurrence
    place = np.concatenate([segments.field("place").to_numpy(), more.flatten().to_numpy()])
    size = hits.value_lengths().to_numpy()
    hit = hits.flatten().to_numpy(zero_copy_only=False)
    at, owner = _ranges(size)[hit], np.repeat(each, size)[hit]
    n = np.bincount(owner, minlength=len(each))
    first = np.cumsum(n) - n
    count = n[segment]
    start = (place >> 16) + segments.field("skip").to_numpy()[segment]
    return np.repeat(docs[segment], count), np.repeat(start, count) + at[np.repeat(first[segment], count) + _ranges(count)]


def _strip(window: int):
    @F.arrow_udf(STRIPPED)
    def strip(texts: pa.Array, found: pa.Array) -> pa.Array:
        words = [(t.as_py() or "").encode().split() for t in texts]
        n_words = np.array([len(w) for w in words], np.int64)
        base = np.cumsum(n_words + 1) - n_words - 1
        doc, start = _hit_windows(found)
        size = int((n_words + 1).sum()) + 1
        begun = np.bincount(base[doc] + start, minlength=size) - np.bincount(base[doc] + start + window, minlength=size)
        keep = np.cumsum(begun) == 0
        n_removed, kept = np.zeros(len(words), np.int64), []
        hit = np.zeros(len(words), bool)
        hit[doc] = True
        for k, w in enumerate(words):
            if hit[k]:
                w = list(itertools.compress(w, keep[base[k] : base[k] + len(w)].tolist()))
                n_removed[k] = n_words[k] - len(w)
            kept.append(b" ".join(w).decode())
        return pa.StructArray.from_arrays([pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept"])

    return strip


def strip_repeats(docs: DataFrame, window: int = 50, text: str = "text", key: str = "doc_id", into: str = "stripped", **options) -> DataFrame:
    """docs with one more column `into`: struct<n_words, n_removed, kept>.

    Words are runs of anything but ASCII white space. A word goes if a window of `window` words covers it whose
    sequence also starts in a document of smaller doc_id; windows are judged on the input. kept holds the
    rest, joined by one space. A null or empty text has no words and an empty kept. Documents of equal doc_id
    do not remove from each other; a null doc_id counts as the greatest. Repeated rows get equal results.
    An empty table gives an empty one. A column named `into` is replaced; any others stay as they are.
    """
    bounded_batches(docs.sparkSession)
    # numbered once, on disk: rows that are equal in all columns stay apart, and no row is known by a hash only
    rest = [c for c, kind in docs.dtypes if kind != "void" and c not in (text, into)]
    own = [F.monotonically_increasing_id().alias("row"), F.coalesce(docs[key].cast("long"), F.lit(LAST)).alias("id"), docs[text].cast("string").alias("text")]
    numbered = spool(docs.select(*own, *([F.struct(*[docs[c] for c in rest]).alias("rest")] if rest else [])), "documents")
    numbered = numbered.where("row is not null")  # the filter that an inner join would add
    found = repeated_windows(numbered, window, **options).withColumnRenamed("row", "at")
    joined = numbered.join(found, F.col("row") == F.col("at"), "left")
    back = {c: F.col("rest").getField(c) for c in rest} | {text: F.col("text")}
    return joined.select(*[back.get(c, F.lit(None)).alias(c) for c in docs.columns if c != into], _strip(window)(F.col("text"), F.col("found")).alias(into))
