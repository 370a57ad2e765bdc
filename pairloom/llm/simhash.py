"""SimHash near-duplicates by anchor-point covering.

The covering code for 64-bit fingerprints is Golay x Golay x {0}: two blocks of 23 bits, each covered by the
binary Golay code with radius 3, and 18 bits that any anchor covers. A fingerprint x has one home anchor, the
codewords within 3 of its two blocks. If y differs from x in at most 2 bits, then x's home lies within
3 + d1 and 3 + d2 of y's blocks for some d1 + d2 <= 2. So y, sent to every such anchor (radius plus
threshold, about 61 of them), meets x at x's home: no link is lost, and each pair meets there exactly once
with x as the smaller fingerprint.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import bounded_batches, spool
from pairloom.llm.components import components

BLOCK, RADIUS, GENERATOR = 23, 3, 0b110001110101
CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles: lower-cased A-Z, words between ASCII white space.

    With fewer words than `width` the whole sequence is the one shingle; without words the result is 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    if len(words) < width:
        pairs = [(0, len(joined))]
    else:
        pairs = list(zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(pairs), CHUNK):
        part = pairs[k : k + CHUNK]
        h = np.fromiter((digest(joined[a:b], seed) for a, b in part), np.uint64, len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(pairs), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


@F.arrow_udf(T.LongType())
def _fp(texts: pa.Array) -> pa.Array:
    return pa.array(np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64))


@functools.cache
def _syndromes() -> np.ndarray:
    """The remainder modulo the generator polynomial of every 23-bit block."""
    out = np.zeros(1 << BLOCK, np.uint16)
    for bit in range(BLOCK):
        r = 1 << bit
        for k in range(bit, BLOCK - 13, -1):
            if k >= 11 and r >> k & 1:
                r ^= GENERATOR << (k - 11)
        out[1 << bit : 2 << bit] = out[: 1 << bit] ^ r
    return out


@functools.cache
def _patterns(threshold: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For d = 0..threshold: (first, count, patterns) by syndrome, of error patterns of weight RADIUS + d (d = 0: up to RADIUS)."""
    syndromes, out = _syndromes(), []
    for d in range(threshold + 1):
        weights = range(RADIUS + 1) if d == 0 else [RADIUS + d]
        errors = np.array([sum(1 << i for i in c) for w in weights for c in itertools.combinations(range(BLOCK), w)], np.int64)
        s = syndromes[errors]
        order = np.argsort(s, kind="stable")
        count = np.bincount(s, minlength=1 << 11)
        out.append((np.cumsum(count) - count, count, errors[order]))
    return out


def anchors(fps: np.ndarray, threshold: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, anchor, is home) for every anchor within covering radius plus threshold."""
    low = (1 << BLOCK) - 1
    y = fps.view(np.uint64)
    y1, y2 = (y & np.uint64(low)).astype(np.int64), (y >> np.uint64(BLOCK) & np.uint64(low)).astype(np.int64)
    s1, s2 = _syndromes()[y1], _syndromes()[y2]
    table, index, anchor, home = _patterns(threshold), [], [], []
    for d1 in range(threshold + 1):
        for d2 in range(threshold + 1 - d1):
            (f1, c1, e1), (f2, c2, e2) = table[d1], table[d2]
            n2 = c2[s2]
            n = c1[s1] * n2
            at = np.repeat(np.arange(len(y)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = y1[at] ^ e1[f1[s1[at]] + k // n2[at]]
            b = y2[at] ^ e2[f2[s2[at]] + k % n2[at]]
            index.append(at)
            anchor.append(a << BLOCK | b)
            home.append(np.full(len(at), d1 + d2 == 0))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def _visits(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            at, anchor, home = anchors(fps, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[at]), pa.array(home)], names=["anchor", "fp", "home"])

    return run


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b) with a < b: distinct fingerprints of column fp that differ in at most `threshold` bits."""
    visits = fps.mapInArrow(_visits(threshold), "anchor long, fp long, home boolean")
    homes = fps.mapInArrow(_visits(0), "anchor long, fp long, home boolean").where("home").select(F.col("anchor").alias("home_anchor"), F.col("fp").alias("a"))
    meet = (F.col("anchor") == F.col("home_anchor")) & (F.col("a") < F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= threshold)
    return visits.select("anchor", "fp").join(homes, meet).select("a", F.col("fp").alias("b"))


def _rooted(nodes: DataFrame, threshold: int) -> DataFrame:
    """nodes (fp, ...) with one more column: root, the least fingerprint that links reach."""
    roots = components(links(nodes.select("fp"), threshold))
    return nodes.join(roots, nodes.fp == roots.node, "left").drop("node").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, threshold: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most `threshold` differing bits reach, the own one
    included. Equal fingerprints are one node, so thousands of copies cost no pairs. Null and empty texts
    have fingerprint 0 and link like others; a null doc_id keeps its row and never becomes a component_id
    (null if the component has no other). Repeated rows give repeated rows; an empty table gives an empty
    result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    own = spool(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash")
    nodes = spool(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    placed = _rooted(nodes, threshold)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = placed.select("fp", "root").join(least, "root").select(F.col("fp").alias("node"), "component_id")
    return own.join(ids, own.fp == ids.node).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, threshold: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each group that near_duplicates would link: that of smallest key.

    A null key counts as the greatest. Of rows with one key, and of repeated rows, within a group any one stays; rows of one key in
    different groups do not affect each other. Null and empty texts are one group. An empty table stays empty; columns stay as they are.
    """
    bounded_batches(docs.sparkSession)
    own = [F.monotonically_increasing_id().alias("row"), F.coalesce(docs[key].cast("long"), F.lit(2**63 - 1)).alias("id"), _fp(docs[text]).alias("fp")]
    rest = [c for c, kind in docs.dtypes if kind != "void"]
    numbered = spool(docs.select(*own, F.struct(*[docs[c] for c in rest]).alias("rest")), "simhash-documents")
    nodes = spool(numbered.groupBy("fp").agg(F.min(F.struct("id", "row")).alias("first")), "simhash-nodes")
    kept = _rooted(nodes, threshold).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("kept"))
    back = {c: F.col("rest").getField(c) for c in rest}
    return numbered.join(kept, F.col("row") == F.col("kept"), "left_semi").select(*[back.get(c, F.lit(None)).alias(c) for c in docs.columns])
