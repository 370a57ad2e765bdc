"""Inverse-frequency weights of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.scores import as_float, score_bin


def histogram(pairs: DataFrame, n: int = 5, identity_scale: float = 1.0, score: str = "score") -> DataFrame:
    """(bin, n, weight) of the bins that occur: 1 / count, and for scores of 1 a last bin with 1 / (scale * count).

    Scores outside [0, 1], NaN and null are refused by being left out.
    """
    valid = pairs.where(F.col(score).between(as_float(0), as_float(1)))
    counts = valid.groupBy(score_bin(F.col(score), n).alias("bin")).agg(F.count("*").alias("n"))
    scale = F.when(F.col("bin") == n, F.lit(identity_scale)).otherwise(1.0)
    return counts.withColumn("weight", F.try_divide(F.lit(1.0), F.col("n") * scale))


def weighted(pairs: DataFrame, n: int = 5, identity_scale: float = 1.0, score: str = "score", into: str = "weight") -> DataFrame:
    """pairs with the weight of their bin; the histogram has n + 1 rows at most and is broadcast."""
    weights = histogram(pairs, n, identity_scale, score).select(F.col("bin").alias("__bin"), F.col("weight").alias(into))
    return pairs.join(F.broadcast(weights), score_bin(F.col(score), n) == F.col("__bin"), "left").drop("__bin")


def dual_weighted(pairs: DataFrame, n: int = 5, identity_scale: float = 1.0, low: float = 0.5, high: float = 0.7, into: str = "weight") -> DataFrame:
    """As weighted, but pairs with score < low and score_max >= high share 1 / (their own count)."""
    local = (F.col("score") < as_float(low)) & (F.col("score_max") >= as_float(high))
    share = pairs.agg(F.try_divide(F.lit(1.0), F.count_if(local)).alias("__local"))
    base = weighted(pairs, n, identity_scale, into="__base")
    return base.join(F.broadcast(share)).withColumn(into, F.when(local, F.col("__local")).otherwise(F.col("__base"))).drop("__base", "__local")


def binary_weighted(pairs: DataFrame, threshold: float, score: str = "score", into: str = "weight") -> DataFrame:
    """1 / (count of the own side of the threshold, which belongs to the upper side)."""
    upper = F.col(score) >= as_float(threshold)
    counts = pairs.agg(F.count_if(upper).alias("__p"), F.count_if(~upper).alias("__n"))
    both = pairs.join(F.broadcast(counts))
    return both.withColumn(into, F.try_divide(F.lit(1.0), F.when(upper, F.col("__p")).otherwise(F.col("__n")))).drop("__p", "__n")
