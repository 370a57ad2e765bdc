"""Structured Streaming forms of the incremental behaviours: resumption, line filters, stateful reservoirs, per-batch
sinks. All run with availableNow, so that a run takes what is new and ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairloom.functions.scores import reservoir_bin
from pairloom.operators.pairs import SIDES, _ids, split_lines


def resume(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> int:
    """Run work over the source's files that no earlier run finished; returns how many rows this run wrote.

    The checkpoint remembers finished files, so a second run adds nothing, and one after a failure goes on.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    query = work(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(int(p["numInputRows"]) for p in query.recentProgress)


def filter_lines(lines: DataFrame, catalog: DataFrame, separator: str = ",") -> DataFrame:
    """A stream of pair lines, as they are, whose both ids are in the (static) catalog."""
    rows = split_lines(lines, separator).where("not blank and not malformed")
    for k, side in enumerate(SIDES):
        rows = rows.join(_ids(catalog, f"__id{k}"), F.col(side) == F.col(f"__id{k}"))
    return rows.select("value")


def reservoirs(pairs: DataFrame, n: int, cap: int, key: str) -> DataFrame:
    """A stream of (bin, rows): after each batch, of each score bin the `cap` rows of smallest key so far.

    State is cap rows a bin, whatever has passed.
    """
    schema = "bin int, key long, domain_i string, domain_j string, score float"
    rows = pairs.where(~F.isnan("score")).select(reservoir_bin(F.col("score"), n).alias("bin"), F.col(key).alias("key"), "domain_i", "domain_j", "score")

    def keep(bin_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["key", "domain_i", "domain_j", "score"]
        held = pd.DataFrame(list(zip(*state.get, strict=True)) if state.exists else [], columns=names)
        for b in batches:
            held = pd.concat([held.astype(b[names].dtypes), b[names]]).nsmallest(cap, "key") if len(held) else b[names].nsmallest(cap, "key")
        state.update(tuple(held[c].tolist() for c in names))
        yield held.assign(bin=bin_[0])[["bin", *names]]

    state = "key array<long>, domain_i array<string>, domain_j array<string>, score array<float>"
    return rows.groupBy("bin").applyInPandasWithState(keep, schema, state, "update", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hand every batch to `write`, once; a batch that was written before a failure comes again with its number."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def epoch_metric(events: DataFrame, epoch: str, prediction: str, target: str) -> DataFrame:
    """(epoch, n, mse): state that starts anew with each epoch is a group by epoch."""
    error = F.col(prediction) - F.col(target)
    return events.groupBy(epoch).agg(F.count("*").alias("n"), F.avg(error * error).alias("mse"))
