"""Shared helpers: table reading, lineage cuts in the shared folder, bounded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.session import discard, spool

__all__ = ["bounded_batches", "discard", "spool", "table", "texts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table that much work is done on: with fewer partitions than cores (a single small file), its rows are dealt out
    over the cores first. A table of many files is read as it lies."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def bounded_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 8) -> None:
    """Keep Arrow batches of whole texts small, in rows and in bytes, so that a Python worker's memory doesn't follow the
    table. Plans are run later, so this holds for the session from now on; a smaller bound that is set already stays."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)):
        now = int(str(spark.conf.get(name)).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))
