"""Augmenters of parallel arrays: removal of residues and permutation of regions, decided by a seed and the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_places(array: Column, places: Column) -> Column:
    """An array without the elements at the given 0-based places."""
    return F.filter(array, lambda x, i: ~F.array_contains(places, i))


def regions_permuted(array: Column, order: Column) -> Column:
    """The n = size(order) regions of an array, region k being [k * len // n, (k + 1) * len // n), in the given order."""
    n, size = F.size(order), F.size(array)
    edge = lambda k: F.floor(k * size / n).cast("int")
    return F.flatten(F.transform(order, lambda k: F.slice(array, edge(k) + 1, edge(k + 1) - edge(k))))


def _draw(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(2**31))


def random_places(key: Column, size: Column, n: Column, seed: int) -> Column:
    """n different places of 0..size-1, drawn by hash of key and seed: those of smallest hash."""
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.xxhash64(key, i, F.lit(seed)).alias("h"), i.alias("i"))))
    return F.transform(F.slice(ranked, F.lit(1), n), lambda s: s["i"])


def remove_residues(rows: DataFrame, arrays: list[str], key: str, n: int, seed: int) -> DataFrame:
    """rows with n places removed from all their arrays alike; shorter rows are refused by an error."""
    first = F.size(arrays[0])
    places = F.when(first >= n, random_places(F.col(key), first, F.lit(n), seed)).otherwise(F.raise_error(F.lit("fewer residues than are to be removed")))
    marked = rows.withColumn("__gone", places)
    return marked.withColumns({a: without_places(F.col(a), F.col("__gone")) for a in arrays}).drop("__gone")


def remove_fraction(rows: DataFrame, arrays: list[str], key: str, fraction: float = 0.1, most: int = 10, seed: int = 0) -> DataFrame:
    """As remove_residues, for 1 to min(floor(fraction * size), most) places, at least 1 being the upper end."""
    size = F.size(arrays[0])
    upper = F.greatest(F.least(F.floor(size * fraction).cast("int"), F.lit(most)), F.lit(1))
    n = (_draw(F.col(key), F.lit(seed), F.lit("n")) % upper + 1).cast("int")
    marked = rows.withColumn("__gone", random_places(F.col(key), size, n, seed))
    return marked.withColumns({a: without_places(F.col(a), F.col("__gone")) for a in arrays}).drop("__gone")


def permute_regions(rows: DataFrame, arrays: list[str], key: str, probability: float = 0.1, splits: int = 5, seed: int = 0) -> DataFrame:
    """rows of which a share of `probability` has its arrays cut into 2 to splits - 1 regions, and these permuted alike."""
    n = (_draw(F.col(key), F.lit(seed), F.lit("n")) % (splits - 2) + 2).cast("int")
    chosen = _draw(F.col(key), F.lit(seed), F.lit("p")) < int(probability * 2**31)
    order = F.when(chosen, random_places(F.col(key), n, n, seed)).otherwise(F.array(F.lit(0)))
    marked = rows.withColumn("__order", order)
    return marked.withColumns({a: regions_permuted(F.col(a), F.col("__order")) for a in arrays}).drop("__order")


def self_pairs_only(rows: DataFrame, augmented: DataFrame, key: str) -> DataFrame:
    """Augmentation of the second side of self pairs: other rows (domain_i <> domain_j) stay as they are."""
    own = F.col("domain_i") == F.col("domain_j")
    return rows.where(~own).unionByName(augmented.where(own))


def composed(rows: DataFrame, steps: list) -> DataFrame:
    """One augmenter after another; each is a function of a DataFrame."""
    for step in steps:
        rows = rows.transform(step)
    return rows
