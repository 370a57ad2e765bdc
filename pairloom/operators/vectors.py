"""Operators on residue vectors in long form (domain, pos, vec) and pooled vectors (id, embedding)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions import vectors as V
from pairloom.operators.pairs import blocks, numbered

#: Numbers compared exactly at once, and what a matrix product of unit vectors may be off by, many times over.
AT_ONCE = 1 << 21
SLACK = 1e-9


def pooled(residues: DataFrame, how: str = "mean", valid: Column | None = None, key: str = "domain", vec: str = "vec") -> DataFrame:
    """(key, embedding): the mean or sum of a domain's vectors, place by place, of those that `valid` marks.

    A domain without valid vectors has zeros (the divisor is at least 1). Sums are combined before the shuffle.
    """
    ok = F.lit(1.0) if valid is None else F.coalesce(valid, F.lit(False)).cast("double")
    long = residues.select(key, ok.alias("__ok"), F.posexplode(V.doubles(F.col(vec))).alias("__at", "__x"))
    sums = long.groupBy(key, "__at").agg(F.sum(F.col("__x") * F.col("__ok")).alias("__s"), F.sum("__ok").alias("__n"))
    value = F.col("__s") / F.greatest("__n", F.lit(1.0)) if how == "mean" else F.col("__s")
    ordered = F.array_sort(F.collect_list(F.struct("__at", value.alias("v"))))
    return sums.groupBy(key).agg(F.transform(ordered, lambda p: p["v"]).alias("embedding"))


def gathered(residues: DataFrame, key: str = "domain", pos: str = "pos", vec: str = "vec") -> DataFrame:
    """(key, vecs): a domain's vectors in order, as one array of arrays."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(vec).alias("v"))))
    return residues.groupBy(key).agg(F.transform(ordered, lambda x: x["v"]).alias("vecs"))


def batches(rows: DataFrame, size: int, *order) -> DataFrame:
    """rows with batch = place // size in the given total order."""
    return numbered(rows, *order, into="__place").withColumn("batch", F.floor(F.col("__place") / size).cast("long")).drop("__place")


def padded_batches(rows: DataFrame, array: str, fill: Column, batch: str = "batch") -> DataFrame:
    """rows with their array padded to the longest of its batch, and mask (true where padding stands)."""
    longest = rows.groupBy(batch).agg(F.max(F.size(array)).alias("__longest"))
    joined = rows.join(longest, batch)
    size = F.col("__longest")
    return joined.withColumns({"mask": V.pad_mask(F.col(array), size), array: V.padded(F.col(array), size, fill)}).drop("__longest")


def within_limit(parts: DataFrame, limit: int, size: str, key: str, order: str) -> DataFrame:
    """The parts of each key up to and with the one that takes the running size over the limit."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("__before", F.coalesce(F.sum(size).over(before), F.lit(0))).where(F.col("__before") <= limit).drop("__before")


def concatenated(parts: DataFrame, key: str, order: str, vecs: str) -> DataFrame:
    """(key, vecs): the parts' arrays of vectors one after another."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(vecs).alias("v"))))
    return parts.groupBy(key).agg(F.flatten(F.transform(ordered, lambda x: x["v"])).alias(vecs))


def cosine_pairs(pairs: DataFrame, into: str = "cosine") -> DataFrame:
    return pairs.withColumn(into, V.cosine(F.col("embedding_i"), F.col("embedding_j")))


def _matrix(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, with zeros after their end, and their sizes; -1 for null or empty ones and those that hold a null.

    Each row is divided by a power of two, which changes no digit of a cosine and keeps squares within the range of doubles.
    """
    lists = lists.combine_chunks()
    sizes, flat = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
    x = np.zeros((len(sizes), max(sizes.max(initial=0), 1)))
    x[np.arange(x.shape[1]) < sizes[:, None]] = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    sizes[np.repeat(np.arange(len(sizes)), sizes)[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
    sizes[sizes == 0] = -1
    top = np.abs(x).max(axis=1, keepdims=True)
    return np.ldexp(x, -np.frexp(np.where(np.isfinite(top), top, 1.0))[1]), sizes


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of rows, summed place by place: equal vectors have equal values, wherever they lie. NaN where one is zero."""
    dot, q2, v2 = (np.cumsum(a * b, axis=1)[:, -1] for a, b in ((q, v), (q, q), (v, v)))
    return np.clip(dot / np.sqrt(q2 * v2), -1.0, 1.0)


def _nearest_in_block(q_ids: pa.Array, q_lists: pa.ChunkedArray, v_ids: pa.Array, v_lists: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(query, vector, cosine), the first two as places: each query's k nearest vectors with another id, by cosine (NaN first,
    null last), then by place. One matrix product finds who can be among them, and these are compared exactly."""
    (q, q_sizes), (v, v_sizes) = _matrix(q_lists), _matrix(v_lists)
    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    with np.errstate(all="ignore"):
        near = unit(q) @ unit(v).T
        near[~np.isfinite(near)] = 2.0
        near[(q_sizes[:, None] != v_sizes) | (q_sizes[:, None] < 0)] = -2.0
        names = q_ids.to_numpy(zero_copy_only=False), v_ids.to_numpy(zero_copy_only=False)
        first, after = (np.searchsorted(names[1], names[0], side) for side in ("left", "right"))
        for row in np.flatnonzero(after > first):
            near[row, first[row] : after[row]] = -np.inf
        from_end = max(len(v) - k, 0)
        least = np.partition(near, from_end, axis=1)[:, from_end, None]
        who, at = np.nonzero((near >= least - SLACK) & (near > -np.inf))
        step = max(1, AT_ONCE // width)
        cosines = np.concatenate([_exact(q[who[i : i + step]], v[at[i : i + step]]) for i in range(0, len(who), step)] or [np.empty(0)])
    missing = near[who, at] == -2.0
    key = np.where(missing, -np.inf, np.where(np.isnan(cosines), np.inf, cosines))
    order = np.lexsort((at, -key, who))
    order = order[np.arange(len(order)) - np.searchsorted(who, who) < k]  # who is sorted already
    return who[order], at[order], pa.array(cosines[order], pa.float64(), mask=missing[order], from_pandas=False)


def top_cosine(queries: DataFrame, vectors: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(query, rank, id, cosine): the k nearest by exact comparison of a stated query set with all rows, in blocks.

    Queries and vectors are dealt to blocks, which follow their numbers (`block` sets those of the vectors). Each block
    keeps its k best before the shuffle, so a query's candidates are k rows a block. A cosine is NaN, and comes first, if a
    vector is zero; it is null, and comes last, if one is null, empty or holds a null, or their sizes differ.
    """
    of_queries, of_vectors = blocks(queries, 1), block or blocks(vectors)
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.where("id is not null").select("id", "embedding", dealt(of_queries).alias("bq"), every(of_vectors).alias("b"))
    v = vectors.where("id is not null").select("id", "embedding", every(of_queries).alias("bq"), dealt(of_vectors).alias("b"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right.column("id")))
        q_ids, v_ids = (t.column("id").combine_chunks() for t in (left, right))
        if not len(q_ids) or not len(v_ids):
            return pa.table({"query": q_ids[:0], "id": v_ids[:0], "cosine": pa.array([], pa.float64())})
        who, at, cosines = _nearest_in_block(q_ids, left.column("embedding"), v_ids, right.column("embedding"), k)
        return pa.table({"query": q_ids.take(pa.array(who)), "id": v_ids.take(pa.array(at)), "cosine": cosines})

    found = T.StructType([T.StructField("query", queries.schema["id"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("cosine", T.DoubleType())])
    first = q.groupBy("bq", "b").cogroup(v.groupBy("bq", "b")).applyInArrow(nearest, found)
    order = [F.desc("cosine"), F.col("id")]
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("query", "rank", "id", "cosine")


def _placed(edges: DataFrame, length: Column) -> DataFrame:
    """(domain, length, places): for each index below the length, in order, its struct (i, nbrs); nbrs is null if it is not listed."""
    kinds = {f.name: f.dataType for f in edges.schema}
    lists = edges.groupBy("domain").agg(F.collect_list(F.struct("i", "nbrs")).alias("rows")).withColumn("length", length.cast("int"))
    listed = F.map_entries(F.map_from_entries("rows"))  # an index that is listed twice is an error
    lists = lists.select("domain", "length", F.transform(listed, lambda e: F.struct(e["key"].alias("i"), e["value"].alias("nbrs"))).alias("rows"))
    inside = F.filter("rows", lambda r: (r["i"] >= 0) & (r["i"] < F.col("length")))
    every = F.when(F.col("length") > 0, F.sequence(F.lit(0), F.col("length") - 1)).otherwise(F.array().cast("array<int>"))
    others = F.array_except(every, F.transform("rows", lambda r: r["i"].cast("int")))
    unlisted = F.transform(others, lambda i: F.struct(i.cast(kinds["i"]).alias("i"), F.lit(None).cast(kinds["nbrs"]).alias("nbrs")))
    return lists.select("domain", "length", F.array_sort(F.concat(inside, unlisted)).alias("places"))


def _open(place: Column, length: Column, include_self: bool) -> Column:
    """The indices that a row of a mask leaves open, in order; null for a row that sees all."""
    nbrs, i = place["nbrs"], place["i"]
    seen = F.transform(F.concat(nbrs, F.array(i)) if include_self else nbrs, lambda j: j.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(seen, lambda j: (j >= 0) & (j < length))))


def _runs(seen: Column, length: Column, shut: bool | str, clear: bool | str) -> Column:
    """A row of a mask as its runs of shut cells, each with the open cell after it: as many as it has open cells, and one."""
    times = F.repeat if isinstance(shut, str) else F.array_repeat
    shut, clear = F.lit(shut), F.lit(clear)
    run = lambda a, b: F.concat(times(shut, b - a - 1), times(clear, (b < length).cast("int")))
    listed = F.zip_with(F.concat(F.array(F.lit(-1)), seen), F.concat(seen, F.array(length)), run)
    return F.when(seen.isNull(), F.array(times(clear, length))).otherwise(listed)


def neighbour_mask(edges: DataFrame, length: Column, include_self: bool = True) -> DataFrame:
    """(domain, length, mask): the attention mask of neighbour lists (domain, i, nbrs), true where attention is shut.

    A listed row sees its neighbours (and itself); any other row sees all. Indices beyond the length count for nothing.
    length is a column of the grouped lists (column rows: array<struct<i, nbrs>>).
    """
    n = F.col("length")
    seen = F.transform("places", lambda p: F.struct(_open(p, n, include_self).alias("seen")))
    return _placed(edges, length).select("domain", "length", F.transform(seen, lambda p: F.flatten(_runs(p["seen"], n, True, False))).alias("mask"))


def neighbour_mask_rows(edges: DataFrame, length: Column, include_self: bool = True) -> DataFrame:
    """(domain, length, row, mask): the rows of `neighbour_mask` one by one, as texts of 1 (shut) and 0, so that no domain's
    mask is held as a whole and no cell is computed by itself."""
    # explode would add a filter on the places, which computes them, and the length for each of them, once more
    rows = _placed(edges, length).select("domain", "length", F.explode_outer("places").alias("p")).where("p is not null")
    rows = rows.select("domain", "length", F.col("p")["i"].alias("row"), _open(F.col("p"), F.col("length"), include_self).alias("__seen"))
    return rows.select("domain", "length", "row", F.array_join(_runs(F.col("__seen"), F.col("length"), "1", "0"), "").alias("mask"))


def default_length() -> Column:
    """The greatest index of the lists, and one slot after it."""
    highest = F.array_max(F.transform("rows", lambda r: F.greatest(r["i"], F.coalesce(F.array_max(r["nbrs"]), r["i"]))))
    return highest + 2
