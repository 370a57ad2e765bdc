"""Ranking and regression metrics over (label, prediction) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.vectors import log_softmax_at
from pairloom.session import spool


def squared_error(prediction: Column, target: Column) -> Column:
    return (prediction - target) * (prediction - target)


def mse(rows: DataFrame, prediction: str, target: str, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.avg(squared_error(F.col(prediction).cast("double"), F.col(target).cast("double"))).alias("mse"))


def _ranked(rows: DataFrame, label: str, prediction: str, parts: int, by: list[str]) -> DataFrame:
    """(by..., prediction, pos, neg, tp, fp) with one row a different prediction: its own counts, and the running ones
    from the greatest prediction down.

    Predictions are cut into ranges, whose totals make a table of a row a range and value of `by`; the running sums are
    taken in each range and shifted, so that no task orders all rows. Rows with a null in `by` are left out.
    """
    known = F.col(prediction).isNotNull() & F.col(label).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    counts = rows.where(known).groupBy(*by, F.col(prediction).alias("prediction"))
    counts = counts.agg(F.count_if(F.col(label) > 0).alias("pos"), F.count_if(F.col(label) <= 0).alias("neg"))
    ranged = spool(counts.repartitionByRange(parts, *by, F.desc("prediction")).withColumn("part", F.spark_partition_id()), "ranked")
    down = Window.partitionBy("part", *by).orderBy(F.desc("prediction")).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("part", *by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    over = Window.partitionBy(*by).orderBy("part")
    starts = totals.select("part", *by, (F.sum("p").over(over) - F.col("p")).alias("p0"), (F.sum("n").over(over) - F.col("n")).alias("n0"))
    run = ranged.select("*", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"))
    return run.join(starts, ["part", *by]).select(*by, "prediction", "pos", "neg", (F.col("tp") + F.col("p0")).alias("tp"), (F.col("fp") + F.col("n0")).alias("fp"))


def roc_auc(rows: DataFrame, label: str, prediction: str, parts: int = 32, by: list[str] | None = None) -> DataFrame:
    """(by..., roc_auc): the share of positive-negative pairs in the right order, ties counting half; null without both kinds."""
    ranked = _ranked(rows, label, prediction, parts, by or []).groupBy(*(by or []))
    # a positive beats the negatives below it: all but those seen so far
    sums = ranked.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2)).alias("lost"))
    return sums.select(*(by or []), (1 - F.try_divide(F.col("lost"), F.col("p") * F.col("n"))).alias("roc_auc"))


def pr_auc(rows: DataFrame, label: str, prediction: str, parts: int = 32, by: list[str] | None = None) -> DataFrame:
    """(by..., pr_auc): the sum over falling thresholds of the recall gained times the precision there; null without positives."""
    ranked = _ranked(rows, label, prediction, parts, by or []).groupBy(*(by or []))
    sums = ranked.agg(F.sum("pos").alias("p"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"))
    return sums.select(*(by or []), F.try_divide(F.col("s"), F.col("p")).alias("pr_auc"))


def mean_of_workers(rows: DataFrame, label: str, prediction: str, worker: str) -> DataFrame:
    """(pr_auc, roc_auc): the means of the workers' own areas, each from the worker's rows alone, as metrics that are
    averaged at the end of an epoch are; an area that a worker has not counts for nothing."""
    of = pr_auc(rows, label, prediction, by=[worker]).join(roc_auc(rows, label, prediction, by=[worker]), worker)
    return of.agg(F.avg("pr_auc").alias("pr_auc"), F.avg("roc_auc").alias("roc_auc"))


def cross_entropy(rows: DataFrame, logits: str, target: str, pad: int = 0, by: list[str] | None = None) -> DataFrame:
    """(loss): mean negative log likelihood of the targets that are not pad."""
    valid = rows.where(F.col(target) != pad)
    return valid.groupBy(*(by or [])).agg((-F.avg(log_softmax_at(F.col(logits), F.col(target)))).alias("loss"))


def best(rows: DataFrame, metric: str, by: str) -> DataFrame:
    """The row's `by` of the greatest metric."""
    return rows.agg(F.max_by(by, metric).alias(by), F.max(metric).alias(metric))
