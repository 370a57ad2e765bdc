"""Operators on sequences (header, sequence): windows and all-against-all identity."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.pairs import all_against_all, set_against_set

# The BLOSUM62 substitution scores, in this order of residues, row by row from the diagonal leftwards.
ORDER = "ARNDCQEGHILKMFPSTWYVBZX*"
LOWER = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
-2 -1 3 4 -3 0 1 -1 0 -3 -4 0 -3 -3 -2 0 -1 -4 -3 -3 4
-1 0 0 1 -3 3 4 -2 0 -3 -3 1 -1 -3 -1 0 -1 -3 -2 -2 1 4
0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2 0 0 -2 -1 -1 -1 -1 -1
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 1
"""


def substitution() -> np.ndarray:
    """Scores by letter code; letters beyond the table, which `identity` does not let through, score like X."""
    table = np.zeros((len(ORDER), len(ORDER)))
    for k, line in enumerate(LOWER.split("\n")[1:-1]):
        table[k, : k + 1] = table[: k + 1, k] = [int(v) for v in line.split()]
    code = np.array([ORDER.find(chr(c)) if ORDER.find(chr(c)) >= 0 else ORDER.find("X") for c in range(256)])
    return table[np.ix_(code, code)]


def identity(a: str, b: str, scores: np.ndarray) -> float:
    """Matches over the shorter length of an optimal alignment. A symbol outside ORDER, in either case, makes it NaN; else an
    empty sequence has identity 0."""
    a, b = a.upper(), b.upper()
    if not set(ORDER).issuperset(a + b):
        return float("nan")
    return align(a, b, scores)[1] / min(len(a), len(b)) if a and b else 0.0


def align(a: str, b: str, scores: np.ndarray, opening: float = 10.0, extending: float = 1.0) -> tuple[float, int]:
    """(score, equal pairs) of an optimal global alignment with affine gaps, which cost nothing at the ends.

    Of alignments that score the same, the trace from the end prefers a pair of residues, then a gap in b, then
    one in a.
    """
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    n, m = len(x), len(y)
    pair = scores[np.ix_(x, y)]
    low = -1e9
    best = np.zeros((n + 1, m + 1))
    up = np.full((n + 1, m + 1), low)  # ends with a residue of a against a gap
    left = np.full((n + 1, m + 1), low)
    steps = np.arange(m + 1) * extending
    for i in range(1, n + 1):
        # the last column lets a's rest stand against nothing for free, and so does the last row for b's
        free = np.zeros(m + 1)
        free[m] = 1
        up[i] = np.maximum(best[i - 1] - np.where(free, 0, opening), up[i - 1] - np.where(free, 0, extending))
        up[i, 0] = low
        row = np.concatenate([[0.0], np.maximum(best[i - 1, :-1] + pair[i - 1], up[i, 1:])])
        if i == n:
            np.maximum.accumulate(row, out=best[i])
            left[i, 1:] = best[i, :-1]
        else:
            # left[j] = max over k < j of row[k] - opening - (j - 1 - k) * extending; row suffices, as a second opening never pays
            reach = np.maximum.accumulate(row + steps)
            left[i, 1:] = reach[:-1] - opening - steps[:-1]
            best[i] = np.maximum(row, left[i])
        best[i, 0] = 0.0
    i, j, matches, state = n, m, 0, "best"
    while i > 0 and j > 0:
        if state == "best":
            if best[i, j] == best[i - 1, j - 1] + pair[i - 1, j - 1]:
                matches += int(x[i - 1] == y[j - 1])
                i, j = i - 1, j - 1
                continue
            state = "up" if best[i, j] == up[i, j] else "left"
        if state == "up":
            if up[i, j] == best[i - 1, j] - (0 if j == m else opening):
                state = "best"
            i -= 1
        else:
            if left[i, j] == best[i, j - 1] - (0 if i == n else opening):
                state = "best"
            j -= 1
    return float(best[n, m]), matches


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    scores = substitution()
    for b in batches:
        values = [identity(a, c, scores) for a, c in zip(b["sequence_i"], b["sequence_j"], strict=True)]
        yield pd.DataFrame({"seq1": b["header_i"], "seq2": b["header_j"], "sequence_identity": values})


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs over all cores: they are few bytes, which would be put together into few tasks, but much work."""
    spark = pairs.sparkSession
    return pairs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


RESULT = "seq1 string, seq2 string, sequence_identity double"


def identities(sequences: DataFrame, block: int | None = None) -> DataFrame:
    """(seq1, seq2, sequence_identity) of each unordered pair of sequences, by alignment; seq1 is the smaller header."""
    rows = sequences.select("header", F.coalesce("sequence", F.lit("")).alias("sequence"))
    return _dealt(all_against_all(rows, "header", ["header", "sequence"], block)).mapInPandas(_align, RESULT)


def cross_identities(left: DataFrame, right: DataFrame, block: int | None = None) -> DataFrame:
    """(seq1, seq2, sequence_identity) of each sequence of left with each of right."""
    rows = [d.select("header", F.coalesce("sequence", F.lit("")).alias("sequence")) for d in (left, right)]
    return _dealt(set_against_set(*rows, ["header", "sequence"], block)).mapInPandas(_align, RESULT)


def ungapped_identity(a, b):
    """Equal letters at equal places over the shorter length, as a column; 0 if either is empty."""
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    same = F.zip_with(letters(a), letters(b), lambda p, q: F.coalesce((p == q).cast("int"), F.lit(0)))
    return F.coalesce(F.try_divide(F.aggregate(same, F.lit(0), lambda s, v: s + v).cast("double"), F.least(F.length(a), F.length(b))), F.lit(0.0))


def windows(sequences: DataFrame, size: int, step: int) -> DataFrame:
    """(header, sequence): windows of each sequence as header|first-last, 1-based; the last is set back to the end.

    A sequence up to the window's size is one window, filled up with X.
    """
    n = F.length("sequence")
    # one pass over the text: a window is seen ahead of each step
    whole = F.transform(F.regexp_extract_all("sequence", F.lit(f"(?s)(?=(.{{{size}}})).{{1,{step}}}"), F.lit(1)), lambda w, k: F.struct((k * step).alias("at"), w.alias("piece")))
    end = F.struct((n - size).alias("at"), F.right("sequence", F.lit(size)).alias("piece"))
    tail = F.when((n - size) % step != 0, F.array(end)).otherwise(F.filter(F.array(end), lambda w: F.lit(False)))
    alone = F.array(F.struct(F.lit(0).alias("at"), F.rpad("sequence", size, "X").alias("piece")))
    # the array is a column first, so that its windows are not multiplied with the text
    rows = sequences.select("header", n.alias("n"), F.when(n <= size, alone).otherwise(F.concat(whole, tail)).alias("windows")).select("header", "n", F.explode("windows").alias("w"))
    last = F.least(F.col("n"), F.col("w.at") + size)
    return rows.select(F.concat("header", F.lit("|"), (F.col("w.at") + 1).cast("string"), F.lit("-"), last.cast("string")).alias("header"), F.col("w.piece").alias("sequence"))


def length_split(sequences: DataFrame, limit: int) -> DataFrame:
    """sequences with bucket: le up to the limit, gt beyond."""
    return sequences.withColumn("bucket", F.when(F.length("sequence") <= limit, "le").otherwise("gt"))


def equal_pair_rows(n: int, workers: int) -> list[tuple[int, int]]:
    """Row ranges of an upper triangle of n items with about equal numbers of pairs. A range ends with the first row that
    brings its own pairs to an equal share of all; the last worker takes what is left, and ranges may be fewer than workers."""
    before = lambda i: i * (n - 1) - i * (i - 1) // 2  # pairs of the first i rows
    share, cuts = n * (n - 1) // 2 / workers, [0]
    while len(cuts) < workers and cuts[-1] < n:
        cut = bisect.bisect_left(range(n + 1), before(cuts[-1]) + share, lo=cuts[-1] + 1, key=before)
        if cut > n:
            break
        cuts.append(cut)
    return list(itertools.pairwise(cuts if cuts[-1] == n else [*cuts, n]))
