"""Stratified, weighted and uniform sampling. Seeds, or keys given as columns, fix what is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.scores import reservoir_bin
from pairloom.operators.pairs import first_rows
from pairloom.session import spool


def uniform(*columns: str, seed: int) -> Column:
    """A number in (0, 1) that a row's columns and the seed decide, so that a recomputed row draws the same."""
    return (F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)


def reservoirs(pairs: DataFrame, max_pairs: int, n: int, key: Column, score: str = "score") -> DataFrame:
    """At most max_pairs // n pairs of each of n score bins, those of smallest key; NaN scores take no part.

    A random key makes each bin a uniform sample of its rows. The limit is applied before the shuffle too, so a
    full bin's rows do not meet in one task.
    """
    rows = pairs.where(F.col(score).isNotNull() & ~F.isnan(score)).withColumns({"__bin": reservoir_bin(F.col(score), n), "__key": key})
    order = Window.partitionBy("__bin").orderBy("__key")
    return rows.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= max_pairs // n).drop("__bin", "__key", "__rn")


def bin_counts(pairs: DataFrame, n: int, score: str = "score") -> DataFrame:
    rows = pairs.where(F.col(score).isNotNull() & ~F.isnan(score))
    return rows.groupBy(reservoir_bin(F.col(score), n).alias("bin")).agg(F.count("*").alias("n"))


def weighted_without_replacement(rows: DataFrame, n: int, weight: str, u: Column, ties: list[str]) -> DataFrame:
    """n rows drawn without replacement in proportion to weight: the smallest -ln(u) / weight. Weight 0 is never drawn."""
    keyed = rows.where(F.col(weight) > 0).withColumn("__key", -F.log(u) / F.col(weight))
    return first_rows(keyed, n, "__key", *ties).drop("__key")


def weighted_with_replacement(rows: DataFrame, draws: DataFrame, weight: str, order: list[str], parts: int = 64) -> DataFrame:
    """One row a draw: draws has a column u in [0, 1); the row is the one whose share of all weight holds u.

    Rows are cut into parts by order. Of each part only its total reaches the driver; a draw goes to its part and is
    placed there by a running sum, so neither side is broadcast whole.
    """
    live = rows.where(F.col(weight) > 0)
    ranged = spool(live.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "shares")
    run = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.withColumn("__to", F.sum(weight).over(run)).withColumn("__from", F.col("__to") - F.col(weight))
    totals = {r["__part"]: r["t"] for r in ranged.groupBy("__part").agg(F.sum(weight).alias("t")).collect()}
    whole, starts, before = sum(totals.values()) or 1.0, [], 0.0
    for p in sorted(totals):
        starts.append((p, before))
        before += totals[p]
    if not starts:
        return draws.join(live.limit(0))
    target = F.col("u") * whole
    at = F.array_max(F.filter(F.array(*[F.struct(F.lit(s).alias("start"), F.lit(p).alias("part")) for p, s in starts]), lambda x: x["start"] <= target))
    placed = draws.withColumn("__at", at).withColumns({"__dpart": F.col("__at.part"), "__v": target - F.col("__at.start")}).drop("__at")
    inside = (F.col("__part") == F.col("__dpart")) & (F.col("__v") >= F.col("__from")) & (F.col("__v") < F.col("__to"))
    return placed.join(sums, inside).drop("__dpart", "__v", "__part", "__from", "__to")


def subset(rows: DataFrame, n: int, key: Column, ties: list[str]) -> DataFrame:
    """n rows of smallest key: a uniform subset if the key is random."""
    return first_rows(rows.withColumn("__key", key), n, "__key", *ties).drop("__key")


def epoch(rows: DataFrame, size: int, order: list[str]) -> DataFrame:
    """The first `size` rows in order, or all if size is not positive."""
    return first_rows(rows, size, *order) if size > 0 else rows
