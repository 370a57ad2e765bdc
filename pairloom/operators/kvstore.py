"""A key -> vector store as a table (id, numbers), numbers being JSON; changes are tables too.

A log holds (id, seq, op, numbers) with op set, update or delete. Folding it gives the store's rows: the last
change of each id decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode(vector: Column) -> Column:
    return F.to_json(vector)


def decode(numbers: Column) -> Column:
    return F.from_json(numbers, "array<double>")


def last_writes(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last row of each key. max over a struct is combined before the shuffle; no key's rows meet in a window."""
    rest = [c for c in log.columns if c not in (key, seq)]
    last = log.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("last"))
    return last.select(key, *[F.col(f"last.{c}").alias(c) for c in (seq, *rest)])


def put(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert or replace: rows (id, numbers) with one row an id."""
    return store.join(rows, "id", "left_anti").select("id", "numbers").unionByName(rows.select("id", "numbers"))


def update(store: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store after replacing, rows whose id the store lacks)."""
    there = rows.join(store.select("id"), "id", "left_semi")
    return put(store, there), rows.join(store.select("id"), "id", "left_anti")


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id").distinct(), "id", "left_anti")


def get(store: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, vector) for each id asked for; null where it is not there."""
    return ids.join(store, "id", "left").select("id", decode(F.col("numbers")).alias("vector"))


def fold(log: DataFrame) -> DataFrame:
    """(id, numbers) after all changes in order of seq; an update of an absent id changes nothing.

    Per id only its last deletion, and what was set or updated after it, count: an update is in force if a set
    came first.
    """
    cleared = log.where("op = 'delete'").groupBy("id").agg(F.max("seq").alias("__cleared"))
    live = log.where("op <> 'delete'").join(cleared, "id", "left").where("__cleared is null or seq > __cleared")
    first = live.where("op = 'set'").groupBy("id").agg(F.min("seq").alias("__first"))
    valid = live.join(first, "id").where(F.col("seq") >= F.col("__first"))
    return last_writes(valid.select("id", "seq", "numbers")).select("id", "numbers")
