"""Operators on scored pairs (domain_i, domain_j, score) and id tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import spool

SIDES = ("domain_i", "domain_j")


def _ids(ids: DataFrame, name: str) -> DataFrame:
    return ids.select(F.col(ids.columns[0]).alias(name)).where(F.col(name).isNotNull()).distinct()


def exclude(pairs: DataFrame, ids: DataFrame, sides=SIDES) -> DataFrame:
    """Pairs of which neither side is among ids (the first column counts); null sides stay."""
    for side in sides:
        pairs = pairs.join(_ids(ids, "__id"), F.col(side) == F.col("__id"), "left_anti")
    return pairs


def known(pairs: DataFrame, ids: DataFrame, sides=SIDES) -> DataFrame:
    """Pairs whose sides are both among ids."""
    for side in sides:
        pairs = pairs.join(_ids(ids, "__id"), F.col(side) == F.col("__id"), "left_semi")
    return pairs


def touching(pairs: DataFrame, ids: DataFrame, sides=SIDES) -> DataFrame:
    """Pairs of which at least one side is among ids: two equi-joins, as an OR would become a nested loop."""
    out = pairs
    for k, side in enumerate(sides):
        mark = _ids(ids, f"__id{k}").withColumn(f"__in{k}", F.lit(True))
        out = out.join(mark, F.col(side) == F.col(f"__id{k}"), "left")
    return out.where("__in0 or __in1").select(pairs.columns)


def unique_ids(pairs: DataFrame, sides=SIDES) -> DataFrame:
    """(domain): every id of either side, once."""
    return pairs.select(F.explode(F.array(*sides)).alias("domain")).where("domain is not null").distinct()


def missing_ids(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(domain): ids of either side that the catalog lacks."""
    return unique_ids(pairs).join(_ids(catalog, "__id"), F.col("domain") == F.col("__id"), "left_anti")


def with_self_pairs(pairs: DataFrame, score: float = 1.0) -> DataFrame:
    """The pairs and (d, d, score) for each of their ids."""
    own = unique_ids(pairs).select(F.col("domain").alias("domain_i"), F.col("domain").alias("domain_j"), F.lit(score).cast("float").alias("score"))
    return pairs.select("domain_i", "domain_j", "score").unionByName(own)


def attach(pairs: DataFrame, catalog: DataFrame, value: str = "embedding", key: str = "domain", sides=SIDES) -> DataFrame:
    """The catalog's value for either side, as value_i and value_j; pairs with an unknown side go."""
    for side, suffix in zip(sides, ("i", "j"), strict=True):
        pairs = pairs.join(catalog.select(F.col(key).alias(side), F.col(value).alias(f"{value}_{suffix}")), side)
    return pairs


def fold_slice(classes: DataFrame, fold: int, folds: int, order: str) -> DataFrame:
    """(class): the fold's slice of the distinct classes in order of `order`; what the folds do not divide is in none."""
    placed = numbered(classes.groupBy("class").agg(F.min(order).alias("__first")), "__first", "class", into="__at")
    size = placed.count() // folds
    return placed.where(F.col("__at").between(fold * size, (fold + 1) * size - 1)).select("class")


def fold_split(pairs: DataFrame, classes: DataFrame, fold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): test pairs touch a domain whose class is in the fold, train pairs do not."""
    held = classes.join(fold.select("class").distinct(), "class", "left_semi").select("domain")
    return exclude(pairs, held), touching(pairs, held)


def enrich(rows: DataFrame, dimension: DataFrame, on: str, value: str) -> DataFrame:
    """rows with the dimension's value where there is one."""
    return rows.join(dimension.select(on, value), on, "left")


def split_lines(lines: DataFrame, separator: str = ",", column: str = "value") -> DataFrame:
    """(value, domain_i, domain_j, blank, malformed) of raw lines; the line itself is kept as it is."""
    parts = F.split(F.col(column), separator, -1)
    blank = F.trim(F.col(column)) == ""
    return lines.select(F.col(column).alias("value"), F.get(parts, 0).alias("domain_i"), F.get(parts, 1).alias("domain_j"), blank.alias("blank"), (~blank & (F.size(parts) < 2)).alias("malformed"))


def sanitise(lines: DataFrame, catalog: DataFrame, separator: str = ",") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept lines as they were, ids missing in the catalog, counters) of raw pair lines."""
    rows = split_lines(lines, separator)
    marks = rows
    for k, side in enumerate(SIDES):
        have = _ids(catalog, f"__id{k}").withColumn(f"__in{k}", F.lit(True))
        marks = marks.join(have, F.col(side) == F.col(f"__id{k}"), "left")
    usable = ~F.col("blank") & ~F.col("malformed")
    keep = usable & F.coalesce(F.col("__in0") & F.col("__in1"), F.lit(False))
    counters = marks.agg(
        F.count_if(~F.col("blank")).alias("total"), F.count_if(keep).alias("kept"), F.count_if(usable & ~keep).alias("dropped"), F.count_if(F.col("malformed")).alias("malformed")
    )
    kept = marks.where(keep).select("value")
    missing = missing_ids(rows.where(usable), catalog)
    return kept, missing, counters


#: Items in a block of a join of all with all, about: a pair of blocks is a million pairs, whatever the table holds.
PER_BLOCK = 1000


def blocks(items: DataFrame, least: int = 8, per_block: int = PER_BLOCK) -> int:
    """How many blocks the items make; small tables make `least`, to have work for all cores."""
    return max(least, -(-items.count() // per_block))


def all_against_all(items: DataFrame, key: str, columns: list[str], block: int | None = None) -> DataFrame:
    """Each unordered pair of items once, as columns of left and right: items are dealt to blocks by hash, and pairs of
    blocks are joined on their number, so that the join is an equi-join over many tasks and never a nested loop.
    The number of blocks follows that of the items unless it is given."""
    block = block or blocks(items)
    blocked = items.select(*columns).withColumn("__b", F.pmod(F.xxhash64(key), F.lit(block)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(block - 1))
    left = blocked.select(*[F.col(c).alias(f"{c}_i") for c in columns], F.col("__b").alias("__bi"), F.explode(every).alias("__bj"))
    right = blocked.select(*[F.col(c).alias(f"{c}_j") for c in columns], F.explode(every).alias("__bi"), F.col("__b").alias("__bj"))
    return left.join(right, ["__bi", "__bj"]).where(F.col(f"{key}_i") < F.col(f"{key}_j")).drop("__bi", "__bj")


def set_against_set(left: DataFrame, right: DataFrame, columns: list[str], block: int | None = None) -> DataFrame:
    """Each pair of a left and a right item, in a task for each pair of their blocks, which follow the items unless given."""
    of_left, of_right = (block or blocks(d) for d in (left, right))
    dealt = lambda n: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.select(*[F.col(c).alias(f"{c}_i") for c in columns], dealt(of_left).alias("__bi"), every(of_right).alias("__bj"))
    b = right.select(*[F.col(c).alias(f"{c}_j") for c in columns], every(of_left).alias("__bi"), dealt(of_right).alias("__bj"))
    return a.join(b, ["__bi", "__bj"]).drop("__bi", "__bj")


def pair_at_index(n: int, index: int) -> tuple[int, int]:
    """(x, y) with x < y of the index-th pair of n items, rows first."""
    if not 0 <= index < n * (n - 1) // 2:
        raise IndexError(index)
    row = n - 2 - int((((8 * (n * (n - 1) // 2 - 1 - index) + 1) ** 0.5) - 1) // 2)
    while row * (2 * n - row - 1) // 2 > index:
        row -= 1
    while (row + 1) * (2 * n - row - 2) // 2 <= index:
        row += 1
    return row, index - row * (2 * n - row - 1) // 2 + row + 1


def pairs_of_indices(indices: DataFrame, n: int, column: str = "index") -> DataFrame:
    """(index, x, y): the pairs at the given positions of the upper triangle of n items, in closed form."""
    i, last = F.col(column), n * (n - 1) // 2 - 1
    back = F.floor((F.sqrt(8.0 * (last - i) + 1) - 1) / 2)
    row = F.lit(n - 2) - back
    start = (row * (2 * n - row - 1) / 2).cast("long")
    return indices.where(i.between(0, last)).select(i, row.cast("long").alias("x"), (i - start + row + 1).cast("long").alias("y"))


def numbered(rows: DataFrame, *order, into: str = "position", parts: int | None = None) -> DataFrame:
    """rows with their 0-based place in a total order: a range partition, counts of its parts, and places within.

    No task holds more than a part; only one count a part reaches the driver. The parts are written down first, as
    the bounds of a range partition are drawn anew each time that it is evaluated.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    inside = ranged.withColumn("__id", F.monotonically_increasing_id())
    inside = spool(inside.withColumns({"__part": F.shiftright("__id", 33).cast("int"), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id"), "numbered")
    counts = inside.groupBy("__part").agg(F.count("*").alias("n"))
    starts = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__start"))
    return inside.join(F.broadcast(starts), "__part").withColumn(into, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def first_rows(rows: DataFrame, n: int, *order, at_once: int = 10_000) -> DataFrame:
    """The n first rows in order. Up to at_once rows each task keeps its n first and one task merges them; more are
    taken by their place, so that no task holds n rows."""
    if n <= at_once:
        return rows.orderBy(*order).limit(n)
    return numbered(rows, *order, into="__place").where(F.col("__place") < n).drop("__place")
