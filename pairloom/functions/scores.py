"""Score functions as columns. Thresholds and bins compare in FLOAT, the type that scores are stored in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_float(value: float) -> Column:
    return F.lit(value).cast("float")


def score_bin(score: Column, n: int) -> Column:
    """floor(n * score) with both sides FLOAT; a score of 1 has a bin of its own, n."""
    return F.floor((as_float(n) * score).cast("float")).cast("int")


def reservoir_bin(score: Column, n: int) -> Column:
    """The bin of a widened score, toward 0; a score of 1 belongs to the last bin."""
    return F.least(F.lit(n - 1), (score.cast("double") * n).cast("int"))


def binary_score(score: Column, threshold: float) -> Column:
    return F.when(score > as_float(threshold), 1.0).otherwise(0.0)


def fraction_score(score: Column, parts: int = 10) -> Column:
    """The nearest of 0, 1/parts, 2/parts, ...; halves go to the even one."""
    return F.rint((as_float(parts) * score).cast("float").cast("double")) / parts


def learning_rate(epoch: Column, warmup: int, epochs: int) -> Column:
    """Factor of a cosine schedule with linear warm-up."""
    rising = F.greatest(F.lit(1e-6), epoch / max(1, warmup))
    falling = 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (epoch - warmup) / max(1, epochs - warmup)))
    return F.when(epoch < warmup, rising).otherwise(falling)
