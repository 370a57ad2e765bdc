"""Sharding by sampled splitters, with DataFrame functions only.

Rows are ordered by (h, doc_id, place), h being the first 60 bits of the text's MD5, so that equal texts lie next to each
other, and place the row's number on disk, so that repeated rows can be parted too. A size-weighted
sample of these keys gives quantile boundaries for many small ranges; every row goes to its range, ranges
that turn out overfull are sampled again and subdivided, and exact running sizes over the ranges give the
shard. Only the ranges depend on the sample: the shard of a row is a function of the whole table.

Driver memory: at most about OVERSAMPLE keys a range, one row a range, and one row for each text that a boundary cuts. All are
fixed by parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import spool

OVERSAMPLE = 16
LEAST = -(2**63)


Key = tuple[int, int, int]


def _range_of(splitters: list[Key], h: Column, i: Column, j: Column) -> Column:
    """How many splitters are <= (h, i, j): a binary search as a fold over step widths."""
    if not splitters:
        return F.lit(0)
    hs, ids, places = (F.lit([s[k] for s in splitters]) for k in range(3))
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]

    def narrow(pos: Column, step: Column) -> Column:
        at = pos + step - 1
        there, id_there = F.get(hs, at), F.get(ids, at)
        below = (pos + step <= len(splitters)) & ((there < h) | ((there == h) & ((id_there < i) | ((id_there == i) & (F.get(places, at) <= j)))))
        return F.when(below, pos + step).otherwise(pos)

    return F.aggregate(F.lit(steps), F.lit(0), narrow)


def _sampled(keys: DataFrame, total: int, wanted: int) -> list[tuple[Key, float]]:
    """About `wanted` keys, drawn with a chance in proportion to size; each with the weight that it stands for."""
    rate = wanted / max(total, 1)
    draw = F.pmod(F.xxhash64("h", "i", "j", F.lit(17)), F.lit(2**40)) / F.lit(float(2**40))
    rows = keys.where(draw < F.col("size") * F.lit(rate)).select("h", "i", "j", "size").collect()
    return sorted(((r.h, r.i, r.j), max(1.0, r.size * rate)) for r in rows)


def _quantiles(sample: list[tuple[Key, float]], parts: int) -> list[Key]:
    """Boundaries of `parts` ranges of equal weight. Only a text that fills whole ranges is cut within, and then one range begins with it."""
    weight, cuts, run = sum(w for _, w in sample), [], 0.0
    for key, w in sample:
        run += w
        while run * parts >= weight * (len(cuts) + 1) and len(cuts) < parts - 1:
            cuts.append(key)
    cuts = sorted(set(cuts))
    return sorted({(c[0], LEAST, LEAST) if not k or cuts[k - 1][0] != c[0] else c for k, c in enumerate(cuts)})


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, ranges_per_shard: int = 32, whole_share: float = 0.01, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: shard k holds the rows whose middle byte, in the order of (h, doc_id), lies in
    the k-th of n_shards equal parts of all bytes. So a shard differs from the mean by one row at most, or by
    one group of equal texts. Such a group goes as a whole by its own middle byte as long as it holds no more than
    `whole_share` of a shard's bytes, which is how far it can upset the law; a larger one is cut where a shard is
    full. slot counts from 0 within the shard without gaps.

    A null text has size 8 and CRC 0, like an empty one. Rows that are equal in all columns keep separate
    slots; rows with null doc_id come first among equal texts. An empty table gives an empty result. Other
    columns of the input are ignored, whatever they are called.
    """
    at = F.col(text)
    keys = spool(
        docs.select(
            F.col(key).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(at), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(at.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.conv(F.substring(F.md5(F.coalesce(at, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long").alias("h"),
            F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("i"),
            F.monotonically_increasing_id().alias("j"),
        ),
        "shard-keys",
    )
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = n_shards * ranges_per_shard
    splitters = _quantiles(_sampled(keys, total, parts * OVERSAMPLE), parts)
    for _ in range(3):
        ranged = keys.withColumn("part", _range_of(splitters, F.col("h"), F.col("i"), F.col("j")))
        sums = {r.part: r.bytes for r in ranged.groupBy("part").agg(F.sum("size").alias("bytes")).collect()}
        full = [p for p, b in sums.items() if b * parts > 3 * total and b > 1 << 20]
        more = set(splitters)
        if full:
            inside = ranged.where(F.col("part").isin(full))
            want = sum(-(-sums[p] * parts // max(total, 1)) for p in full)
            more |= set(_quantiles(_sampled(inside, sum(sums[p] for p in full), want * OVERSAMPLE), want))
        if len(more) == len(splitters):
            break
        splitters = sorted(more)
    before, run = [], 0
    for p in range(len(splitters) + 1):
        before.append(run)
        run += sums.get(p, 0)
    # texts that lie in several ranges: their bytes are those of all ranges, and one range begins with them
    begins = {s[0]: k + 1 for k, s in enumerate(splitters) if s[1:] == (LEAST, LEAST)}
    cut = sorted({s[0] for s in splitters if s[1:] != (LEAST, LEAST)})
    spans = keys.where(F.col("h").isin(cut)).groupBy("h").agg(F.sum("size").alias("bytes")).collect() if cut else []
    spans = docs.sparkSession.createDataFrame([(r.h, r.bytes, before[begins[r.h]]) for r in spans], "span long, span_bytes long, span_start long")

    in_order = Window.partitionBy("part").orderBy("h", "i", "j")
    same_text = Window.partitionBy("part", "h")
    up_to = in_order.rowsBetween(Window.unboundedPreceding, 0)
    start = F.get(F.lit(before), F.col("part")) + F.col("run") - F.col("size")
    ordered = ranged.select("*", F.sum("size").over(up_to).alias("run"), F.row_number().over(in_order).alias("rn"))
    ordered = ordered.select("*", F.sum("size").over(same_text).alias("of_text"), (F.min("run").over(same_text)).alias("first_run"), F.min_by("size", "run").over(same_text).alias("first_size"))
    ordered = ordered.join(F.broadcast(spans), F.col("h") == F.col("span"), "left")
    text_start = F.coalesce("span_start", F.get(F.lit(before), F.col("part")) + F.col("first_run") - F.col("first_size"))
    of_text = F.coalesce("span_bytes", "of_text")
    whole = of_text * n_shards <= F.lit(whole_share * total)
    twice_middle = F.when(whole, 2 * text_start + of_text).otherwise(2 * start + F.col("size"))
    shard = F.least(F.lit(n_shards - 1), F.floor(twice_middle * n_shards / F.lit(max(2 * total, 1)))).cast("int")
    placed = spool(ordered.select("doc_id", "size", "text_crc32", shard.alias("shard"), "part", "rn"), "shard-placed")

    # at most one row a range and shard boundary
    firsts = placed.groupBy("shard", "part").agg(F.min("rn").alias("rn0"), F.count("*").alias("n"))
    firsts = firsts.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n"))
    return placed.join(F.broadcast(firsts.drop("n")), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rn") - F.col("rn0")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
