"""Lexical retrieval packing: each shard's BM25 inverted index fills windows with similar documents.

Documents are tokenised where they are read, and written down once. Full windows of a long document are sequences
as they stand, so only their checksums travel; what is left of each document, its tail, is what BM25 knows as a
document. Count, mean length and document frequencies are those of all tails. Tails are ordered by a sketch of
their terms (the least hashes, so that tails with many terms in common lie near each other) and go, with their
ids, to shards that are equal ranges of that order. A shard indexes what it got, takes a seed, asks the index for
unused neighbours, and fills the window; the neighbour that no longer fits is cut, and its rest is the next seed.
A shard's memory is bounded by docs_per_shard windows and its square of scores, whatever the table holds. Neighbours in other shards are
not seen: the README says how many that are.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import bounded_batches, spool
from pairloom.llm.tokens import byte_bpe, encode

END_ID = 0
TOKENISED = "doc_id long, doc_tokens long, full_crcs array<long>, tail binary, sketch binary, row long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def sketch(ids: np.ndarray, size: int = 8) -> bytes:
    """The least hashes of the distinct ids, in order: the more terms two lists share, the longer a beginning of it they have in common."""
    h = np.unique(ids).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
    return np.sort(h)[:size].astype(">u4").tobytes()


def _tokenise(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        row = 0
        for b in batches:
            sizes, crcs, tails, sketches = [], [], [], []
            for text in b.column(1):
                ids = np.append(encode(bpe, text.as_py() or ""), np.uint32(END_ID)).astype("<u4", copy=False)
                whole = len(ids) // window * window
                sizes.append(len(ids))
                crcs.append([zlib.crc32(ids[k : k + window]) for k in range(0, whole, window)])
                tails.append(ids[whole:].astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\0" + ids[whole:].tobytes())
                sketches.append(sketch(ids[whole:]))
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(sketches, pa.binary()), pa.array(range(row, row + len(sizes)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TOKENISED.split(", ")])
            row += len(sizes)

    return run


def _tail_ids(raw: bytes) -> np.ndarray:
    """Two bytes an id; an odd length marks four bytes an id after the first byte."""
    return np.frombuffer(raw, "<u4", offset=1) if len(raw) % 2 else np.frombuffer(raw, "<u2").astype("<u4")


#: Figures of the table beside the terms' document frequencies, under ids that no vocabulary has.
ROWS, TAILS, IDS = -1, -2, -3


@dataclasses.dataclass(frozen=True)
class Statistics:
    """Count and mean length of all documents, and in how many of them each term is (by term id)."""

    n: int
    mean: float
    df: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): of one partition, how many tails hold each term; and ROWS, TAILS, IDS."""
    df, rows, held, total = np.zeros(0, np.int64), 0, 0, 0
    for b in batches:
        tails = [t for t in map(_tail_ids, b.column(0).to_pylist()) if len(t)]
        rows += b.num_rows
        held += len(tails)
        if tails:
            sizes = [len(t) for t in tails]
            total += sum(sizes)
            pairs = np.unique(np.repeat(np.arange(len(tails)), sizes) << 32 | np.concatenate(tails).astype(np.int64))
            more = np.bincount(pairs & 0xFFFFFFFF, minlength=len(df))
            more[: len(df)] += df
            df = more
    terms = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([ROWS, TAILS, IDS, *terms.tolist()], pa.int64()), pa.array([rows, held, total, *df[terms].tolist()], pa.int64())], names=["term", "n"])


def statistics(tokenised: DataFrame) -> tuple[int, Statistics]:
    """The number of rows, and the statistics of all their tails. The driver gets one row a term of the vocabulary."""
    sums = tokenised.select("tail").mapInArrow(_count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in sums}
    rows, n, total = (found.pop(k, 0) for k in (ROWS, TAILS, IDS))
    df = np.zeros(max(found, default=-1) + 1, np.int64)
    df[list(found)] = list(found.values())
    return rows, Statistics(n, total / max(n, 1), df)


class Bm25:
    """An inverted index over token ids: for each term its documents and their BM25 weights.

    Weights are by the given statistics, else by those of the documents themselves. A document asks with all of
    its terms, or with its query_terms strongest. Takes four bytes for each two documents.
    """

    def __init__(self, docs: list[np.ndarray], query_terms: int | None = None, k1: float = 1.2, b: float = 0.75, of: Statistics | None = None):
        self.n = len(docs)
        sizes = np.array([len(d) for d in docs])
        owner, ids = np.repeat(np.arange(self.n), sizes), np.concatenate(docs).astype(np.int64)
        pairs, tf = np.unique(ids * self.n + owner, return_counts=True)  # by term, then document
        term, doc = pairs // self.n, pairs % self.n
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        n, mean, everywhere = (of.n, of.mean, of.df[self.terms]) if of else (self.n, sizes.mean(), df)
        idf = np.log1p((n - everywhere + 0.5) / (everywhere + 0.5))
        weight = np.repeat(idf, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / mean))
        self.doc, self.weight, self.first, self.df = doc, weight, first, df
        slot, counts = np.repeat(np.arange(len(self.terms)), df), np.bincount(doc, minlength=self.n)
        order = np.argsort(doc, kind="stable") if query_terms is None else np.lexsort((slot, -weight, doc))
        if query_terms is not None:
            rank = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
            order, counts = order[rank < query_terms], np.minimum(counts, query_terms)
        asks, asker = slot[order], np.repeat(np.arange(self.n), counts)
        # terms in an eighth of the documents or more are nearly all of the work: one product scores them for all queries
        common = df * 8 >= self.n
        row, listed, asked = np.cumsum(common) - 1, common[slot], common[asks]
        weights, queries = np.zeros((common.sum(), self.n), np.float32), np.zeros((self.n, common.sum()), np.float32)
        weights[row[slot[listed]], doc[listed]] = weight[listed]
        queries[asker[asked], row[asks[asked]]] = 1
        self.by_common = queries @ weights
        self.query, self.query_end = asks[~asked], np.cumsum(np.bincount(asker[~asked], minlength=self.n))

    def scores(self, doc: int) -> np.ndarray:
        """The BM25 score of every document of the shard for one document's query."""
        q = self.query[self.query_end[doc - 1] if doc else 0 : self.query_end[doc]]
        n = self.df[q]
        at = np.arange(n.sum()) + np.repeat(self.first[q] - np.cumsum(n) + n, n)
        return self.by_common[doc] + np.bincount(self.doc[at], self.weight[at], minlength=self.n)


def ranked(scores: np.ndarray, head: int = 32) -> Iterator[int]:
    """All documents that score above 0, the best first, of equal ones the first; sorted only as far as they are asked for."""
    rest = np.flatnonzero(scores > 0)
    while len(rest):
        least = -np.partition(-scores[rest], head - 1)[head - 1] if len(rest) > head else 0.0
        top = scores[rest] >= least
        now, rest, head = rest[top], rest[~top], head * 4
        yield from now[np.lexsort((now, -scores[now]))].tolist()


def fill_windows(docs: list[np.ndarray], window: int, of: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length); every id of every document lies in exactly one; all but the last are full.

    A window takes its seed's unused neighbours as they rank, the last of them cut; only when none scores above 0,
    the next unused documents.
    """
    if not docs:
        return []
    index = Bm25(docs, of=of)
    size = np.array([len(d) for d in docs])
    unused = np.ones(len(docs), bool)
    queue = iter(range(len(docs)))
    windows, rest = [], None
    while True:
        if rest is None:
            seed = next((d for d in queue if unused[d]), None)
            if seed is None:
                return windows
            rest, unused[seed] = (seed, 0), False
        seed, start = rest
        rest, now, room = None, [(seed, start, int(size[seed]) - start)], window - int(size[seed]) + start
        if room:
            near = ranked(np.where(unused, index.scores(seed), 0.0))
            while room:
                d = next(near, None)
                if d is None:
                    d = next((d for d in queue if unused[d]), None)
                if d is None:
                    break
                unused[d] = False
                take = min(room, int(size[d]))
                now.append((d, 0, take))
                room -= take
                if take < size[d]:
                    rest = (d, take)
        windows.append(now)


def _pack(window: int, of: Broadcast):
    def pieces(table: pa.Table, shard: int) -> pa.RecordBatch:
        table = table.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("tail", "ascending")])
        ids, sizes = table.column("doc_id").to_pylist(), table.column("doc_tokens").to_pylist()
        rows, sequence = [], shard << 32
        for doc_id, n, crcs in zip(ids, sizes, table.column("full_crcs").to_pylist(), strict=True):
            for k, crc in enumerate(crcs):
                rows.append((doc_id, k * window, window, crc, n, sequence, 0))
                sequence += 1
        tails = [_tail_ids(t) for t in table.column("tail").to_pylist()]
        owner = [k for k, t in enumerate(tails) if len(t)]
        tails = [tails[k] for k in owner]
        for parts in fill_windows(tails, window, of=of.value):
            offset = 0
            for d, start, length in parts:
                k = owner[d]
                before = sizes[k] - len(tails[d])
                rows.append((ids[k], before + start, length, ids_crc32(tails[d][start : start + length]), sizes[k], sequence, offset))
                offset += length
            sequence += 1
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield pieces(pa.Table.from_batches(got), TaskContext.get().partitionId())

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, docs_per_shard: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and an end id 0, so a null or empty text is that id alone. Each id lies in one piece.
    Every sequence is full but the last of each shard of about docs_per_shard documents. Repeated rows are
    packed one by one; rows with null doc_id are packed too; an empty table gives no pieces. Other columns are
    ignored. window must be below 2**16.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tokenised = spool(own.mapInArrow(_tokenise(vocabulary, window), TOKENISED), "tokenised")
    rows, of = statistics(tokenised)
    # doc_id and the row's place part rows of one sketch, so that a range never outgrows its share
    dealt = tokenised.repartitionByRange(-(-rows // docs_per_shard) or 1, "sketch", "doc_id", "row").drop("sketch", "row")
    return dealt.mapInArrow(_pack(window, spark.sparkContext.broadcast(of)), PIECES)
