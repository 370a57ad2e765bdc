"""Approximate nearest neighbours by inner product: stable projections, a kd-tree, and a chi-square stopping test.

With M the greatest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so
the largest inner products are the nearest points. A Gaussian (2-stable) projection to m dimensions turns a
distance r into r^2 times a chi-square variable of m degrees. If the k-th best found so far has distance r_k,
a better point lies within a projected distance of r_k * sqrt(quantile(confidence)) with that confidence; points
are verified in order of projected distance, leaf after leaf, until none is left within it.

The kd-tree's splits come from a bounded sample; every vector is then placed in its leaf, and leaves are the units
of work. Queries visit leaves in order of their boxes' distance, in rounds (the first, then up to the 8th, the 64th, ...);
before each round the test drops the leaves that lie beyond the distance found by then, and when none is left for any query
the search ends. Equal vectors are one point with their smallest ids, so copies, however many, cost nothing and lose nothing.

A task holds leaf_rows vectors and about block_queries queries, whatever the table's size: larger leaves are dealt to
several cells, and a leaf's visitors, which each round counts first, to blocks. A leaf's vectors are copied once for each
block of its visitors, so what is copied follows the visits and not vectors times queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import discard, spool

SAMPLES_A_LEAF = 64
MAX_LEAVES = 4096
QUERIES_AT_ONCE = 128


def chi_square_cdf(x: float, m: int) -> float:
    """For an even number m of degrees."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 40.0 * m
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, m) < p else (lo, mid)
    return hi


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Tree:
    """Axis splits from a sample of projected points, to leaves of equal shares; also the projection itself."""

    def __init__(self, dim: int, m: int, max_square: float, seed: int):
        self.dim, self.m, self.max_square = dim, m, max_square
        self.gauss = np.random.default_rng(seed).normal(size=(dim + 1, m))
        self.splits: list[tuple[int, float]] = []  # a heap: node k has children 2k + 1 and 2k + 2
        self.depth = 0

    def place(self, x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.max_square - np.einsum("ij,ij->i", x, x)))
        return x @ self.gauss[:-1] + extra[:, None] * self.gauss[-1]

    def grow(self, sample: np.ndarray, depth: int) -> None:
        self.depth, level = depth, [sample]
        low, high = [np.full(self.m, -np.inf)], [np.full(self.m, np.inf)]
        for _ in range(depth):
            nxt, lows, highs = [], [], []
            for points, lo, hi in zip(level, low, high, strict=True):
                d = int(np.argmax(points.max(axis=0) - points.min(axis=0))) if len(points) else 0
                cut = float(np.median(points[:, d])) if len(points) else 0.0
                cut = min(max(cut, lo[d]), hi[d])
                self.splits.append((d, cut))
                left = points[:, d] <= cut
                nxt += [points[left], points[~left]]
                end, begin = hi.copy(), lo.copy()
                end[d] = begin[d] = cut
                lows += [lo, begin]
                highs += [end, hi]
            level, low, high = nxt, lows, highs
        self.low, self.high = np.array(low), np.array(high)

    def leaf(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        dims, cuts = np.array([s[0] for s in self.splits] or [0]), np.array([s[1] for s in self.splits] or [0.0])
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), dims[node]] > cuts[node])
        return node - (2**self.depth - 1)

    def box_squares(self, p: np.ndarray) -> np.ndarray:
        """Squared distance of one projected point to each leaf's box."""
        off = np.maximum(0, np.maximum(self.low - p, p - self.high))
        return np.einsum("ij,ij->i", off, off)


def _verify(x: np.ndarray, px: np.ndarray, q: np.ndarray, pq: np.ndarray, radius: np.ndarray, spread: float, tree: Tree, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of the best `keep` of one leaf, and what ties with them, for each query: of the points whose projected
    distance passes the test with the squared radius known by now, and whose score can matter beside it."""
    squares = (px * px).sum(axis=1) + (pq * pq).sum(axis=1)[:, None] - 2 * pq @ px.T
    rough = q @ x.T
    slack = lambda v: 1e-9 * (1 + np.abs(v))  # products of many rows at once differ in their last digits
    known = ((q * q).sum(axis=1) + tree.max_square - radius) / 2  # the keep-th best score of earlier rounds
    ok = (squares <= (spread * radius + slack(spread * radius))[:, None]) & (rough >= (known - slack(known))[:, None])
    if len(x) > keep:
        last = np.partition(np.where(ok, rough, -np.inf), len(x) - keep, axis=1)[:, len(x) - keep]
        ok &= rough >= (last - slack(last))[:, None]
    who, at = np.nonzero(ok)
    return who, at, (x[at] * q[who]).sum(axis=1)  # row by row, so that equal vectors score equally wherever they are


def usable(vector: Column, dim: int | None = None) -> Column:
    """Not null, not zero, and all components there and finite (and of the given length)."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0)
    return F.coalesce(ok if dim is None else ok & (F.size(vector) == dim), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, m: int = 8, confidence: float = 0.96, leaf_rows: int = 2048, block_queries: int = 50_000, seed: int = 7, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query marks, the k rows of largest inner product found, but itself.

    Scores are inner products of the original vectors in double precision; ties go to the smaller vec_id. Each
    true neighbour is found with a probability of at least `confidence`. With fewer than k candidates, all are
    returned. Unusable vectors (null, zero, with null or non-finite components, or of another length than most)
    and rows with null key take no part. Rows repeated with one key count as one. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = sizes.dim if sizes else 1
    rows = rows.where(F.size("vector") == dim).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64("vector", F.lit(1))})
    rows = spool(rows, "vectors")

    # equal vectors: the k + 1 smallest ids are all that any answer can hold; the limit applies before the shuffle too
    of = Window.partitionBy("h1", "h2").orderBy("vec_id")
    least = rows.withColumn("rn", F.dense_rank().over(of)).where(F.col("rn") <= k + 1)
    points = least.groupBy("h1", "h2").agg(F.min("vec_id").alias("point"), F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("vector").alias("vector"))
    points = spool(points, "points")
    asked = rows.where("asks").select("vec_id", "h1", "h2").distinct()
    queries = spool(asked.join(points.select("h1", "h2", "point"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "point"), "queries")
    asking = spool(points.join(queries.select(F.col("point").alias("of")).distinct(), F.col("point") == F.col("of")).select("point", "vector"), "asking")

    n, n_asking = points.count(), asking.count()
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    max_square = (points.agg(F.max(square)).first()[0] or 0.0) * (1 + 1e-9)
    depth = min(int(math.log2(MAX_LEAVES)), max(0, math.ceil(math.log2(max(1, n / leaf_rows)))))
    tree = Tree(dim, m, max_square, seed)
    picked = points.select("vector", "point").orderBy(F.xxhash64("point"), "point").limit(SAMPLES_A_LEAF << depth)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([p.astype(np.float64).tobytes() for p in tree.place(_matrix(b.column(0), dim), False)], pa.binary())], names=["p"])

    sample = [np.frombuffer(r.p) for r in picked.select("vector").mapInArrow(project, "p binary").collect()]
    tree.grow(np.array(sample).reshape(-1, m), depth)
    leaves = 1 << depth
    salts = max(1, -(-n // (leaves * 2 * leaf_rows)))
    spread, keep = chi_square_quantile(confidence, m), k + 1

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.leaf(tree.place(_matrix(b.column(1), dim), False))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column(0), b.column(1)], names=["leaf", "point", "vector"])

    def wanted(b: pa.RecordBatch, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the batch, leaf) of each visit of (point, vector, floor) in this round; and the squared radius of each row."""
        floors, x = b.column(2).to_numpy(zero_copy_only=False), _matrix(b.column(1), dim)
        squares = np.maximum(0.0, np.einsum("ij,ij->i", x, x) + max_square - 2 * floors.astype(np.float64))
        radius = np.where(np.isfinite(squares), squares, np.inf)
        found = []
        for i, p in enumerate(tree.place(x, True)):
            boxes = tree.box_squares(p)
            order = np.argsort(boxes, kind="stable")[first:last]
            found.append(order[boxes[order] <= spread * radius[i]])
        return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate([np.empty(0, np.int64), *found]), radius

    def count(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            visits = np.zeros(leaves, np.int64)
            for b in batches:
                visits += np.bincount(wanted(b, first, last)[1], minlength=leaves)
            at = np.flatnonzero(visits)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(visits[at])], names=["leaf", "visits"])

        return run

    def visits(first: int, last: int, blocks: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, leaf, radius = wanted(b, first, last)
                at, leaf, salt = np.repeat(at, salts), np.repeat(leaf, salts), np.tile(np.arange(salts), len(at))
                cell = (leaf * salts + salt) * blocks.max() + b.column(0).to_numpy()[at] % blocks[leaf]
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0).take(rows), b.column(1).take(rows), pa.array(radius[at])], names=["cell", "asker", "vector", "radius"])

        return run

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        askers, out = left.column("asker").to_numpy(), []
        if len(askers) and right.num_rows:
            ids = right.column("point").to_numpy()
            x, q = (_matrix(t.column("vector").combine_chunks(), dim) for t in (right, left))
            px, pq = tree.place(x, False), tree.place(q, True)
            radius = left.column("radius").to_numpy()
            for k in range(0, len(askers), QUERIES_AT_ONCE):
                some = slice(k, k + QUERIES_AT_ONCE)
                who, at, scores = _verify(x, px, q[some], pq[some], radius[some], spread, tree, keep)
                out.append((askers[some][who], ids[at], scores))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"asker": pa.array(columns[0], pa.int64()), "point": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    kind = dict(points.dtypes)["vector"]
    laid = spool(points.select("point", "vector").mapInArrow(lay, f"leaf long, point long, vector {kind}"), "leaves")
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "point")
    best, first, last = spool(spark.range(0).selectExpr("id AS asker", "id AS point", "0D AS score"), "best"), 0, 1
    while first < leaves:
        floors = best.groupBy("asker").agg(F.when(F.count("*") >= keep, F.min("score")).otherwise(float("-inf")).alias("floor"))
        now = asking.join(floors, F.col("point") == F.col("asker"), "left").select("point", "vector", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        # one row a leaf, of which there are MAX_LEAVES at most
        counted = {r.leaf: r.visits for r in now.mapInArrow(count(first, last), "leaf long, visits long").groupBy("leaf").agg(F.sum("visits").alias("visits")).collect()}
        if not counted:
            break
        blocks = np.array([-(-counted.get(k, 0) // block_queries) for k in range(leaves)])
        in_blocks = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block")
        dealt = laid.withColumn("n_blocks", F.get(F.lit(blocks.tolist()), F.col("leaf").cast("int"))).where("n_blocks > 0").select("leaf", "point", "vector", in_blocks)
        cell = ((F.col("leaf") * salts + F.pmod("point", F.lit(salts))) * int(blocks.max()) + F.col("block")).alias("cell")
        going = now.mapInArrow(visits(first, last, blocks), f"cell long, asker long, vector {kind}, radius double")
        found = going.groupBy("cell").cogroup(dealt.select(cell, "point", "vector").groupBy("cell")).applyInArrow(search, "asker long, point long, score double").unionByName(best)
        before, best = best, spool(found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep).drop("rn"), "best")
        discard(before)
        first, last = last, last * 8

    # points back to ids: k + 1 for each asking point, less the query itself
    ids = best.join(points.select("point", "ids"), "point").select("asker", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("rn", F.row_number().over(by_id)).where(F.col("rn") <= keep)
    lists = ids.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("found"))
    answers = queries.join(lists, F.col("point") == F.col("asker")).select("query_id", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return answers.select("query_id", F.posexplode("found").alias("rank", "f")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")
