"""Writers. Each writes part files in parallel; `single` asks for one file where a consumer needs it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.sequences import four_decimals


def _out(df: DataFrame, single: bool = False):
    return (df.coalesce(1) if single else df).write.mode("overwrite")


def write_pairs(pairs: DataFrame, path: str, separator: str = ",", header: bool = False, single: bool = False) -> None:
    _out(pairs, single).options(sep=separator, header=str(header).lower(), emptyValue="").csv(path)


def write_identities(pairs: DataFrame, path: str, single: bool = False) -> None:
    """seq1, seq2, sequence_identity with a header, four decimals, nan where there is none."""
    rows = pairs.select("seq1", "seq2", four_decimals(F.col("sequence_identity")).alias("sequence_identity"))
    write_pairs(rows, path, "\t", True, single)


def write_vector_files(vectors: DataFrame, path: str, key: str = "id", vector: str = "embedding", replace_keys: bool = False) -> None:
    """A directory an id with one number a line, in order; rows without a vector are skipped.

    With replace_keys only the directories of the ids written are replaced, and others stay.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("at", "number"))
    ordered = rows.repartition(key).sortWithinPartitions(key, "at").select(key, F.col("number").cast("string").alias("number"))
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if replace_keys else "static").partitionBy(key).text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """All vectors as one Parquet dataset."""
    vectors.write.mode("overwrite").parquet(path)


def neighbour_lines(lists: DataFrame, token=None, nbrs: str = "nbrs", keep: list[str] | None = None) -> DataFrame:
    """(keep..., value): one line a residue, its token and those of its neighbours, tab-separated. token maps an index column."""
    token = token or (lambda i: i.cast("string"))
    return lists.select(*(keep or []), F.array_join(F.concat(F.array(token(F.col("i"))), F.transform(nbrs, token)), "\t").alias("value"))


def write_lines(lines: DataFrame, path: str, single: bool = False, by: str | None = None) -> None:
    """Lines of text; with `by`, in a directory for each of its values."""
    if by is None:
        _out(lines.select("value"), single).text(path)
    else:
        _out(lines.repartition(by).select(by, "value")).partitionBy(by).text(path)


def fasta_records(sequences: DataFrame) -> DataFrame:
    return sequences.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("sequence")).alias("value"))


def write_fasta(sequences: DataFrame, path: str, single: bool = False) -> None:
    write_lines(fasta_records(sequences), path, single)


def write_split(rows: DataFrame, path: str, by: str = "bucket") -> None:
    """A directory for each value of `by`."""
    rows.write.mode("overwrite").partitionBy(by).parquet(path)


def write_with_failures(rows: DataFrame, path: str, failures: str, error: str = "error") -> None:
    """Rows without an error to path, the others to failures: a table to look into and to run again."""
    rows.where(F.col(error).isNull()).drop(error).write.mode("overwrite").parquet(path)
    rows.where(F.col(error).isNotNull()).write.mode("overwrite").parquet(failures)


def not_done(ids: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Ids that are not among the finished ones."""
    return ids.join(done.select(key).distinct(), key, "left_anti")
