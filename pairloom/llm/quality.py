"""Quality classifier by positive-unlabelled learning.

Trusted positives (labels of quality 1) and unlabelled documents are drawn; a small network minimises the
non-negative unbiased risk  prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)). The class prior is estimated from
how positives that a classifier of P against U did not see score, less a margin; no negative label is read. Inputs are
the hashed words, pairs of words and byte trigrams of a text, and shares of byte kinds, words and lines. Scores depend
on the text alone.

The fit sees a bounded sample: at most `max_positives` labelled rows and about `max_unlabelled` others, both
drawn by hash. Everything else, the scores included, covers all rows and whole texts.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import bounded_batches

PUNCTUATION = np.frombuffer(string.punctuation.encode(), np.uint8)
N_SHARES = len(PUNCTUATION) + 15
N_HASHED = 512
N_FEATURES = N_SHARES + N_HASHED


def _buckets(h: np.ndarray) -> np.ndarray:
    """How many of the hashes fall into each of N_HASHED buckets."""
    return np.bincount((h * np.uint32(0x9E3779B1) >> np.uint32(23)).astype(np.int64), minlength=N_HASHED)


def hashed(raw: bytes, words: list[bytes]) -> np.ndarray:
    """Words, pairs of neighbouring words, and byte trigrams, hashed: logarithms of their counts, as a unit vector."""
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    counts = _buckets(h) + _buckets(h[:-1] * np.uint32(0x85EBCA6B) ^ h[1:]) + _buckets(b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:])
    logs = np.log1p(counts)
    return logs / max(1e-9, float(np.sqrt(logs @ logs)))


def features(text: str | None) -> np.ndarray:
    """Shares of byte kinds, of words and of lines of a whole text, then its hashed terms; all 0 for an empty one."""
    raw = (text or "").encode()
    out = np.zeros(N_FEATURES, np.float16)
    if not raw:
        return out
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    out[: len(PUNCTUATION)] = np.sqrt(share[PUNCTUATION])
    upper, lower = share[65:91].sum(), share[97:123].sum()
    words, lines = raw.split(), raw.split(b"\n")
    n = len(words)
    counts = Counter(words)
    rest = out[len(PUNCTUATION) : N_SHARES]
    rest[:6] = upper, lower, upper / (upper + lower + 1e-9), share[48:58].sum(), share[[9, 10, 11, 12, 13, 32]].sum(), share[128:].sum()
    rest[6:8] = np.log1p(len(raw)) / 10, share[:9].sum() + share[14:32].sum() + share[127]
    if n:
        top = max(counts.values())
        again = sum(map(bytes.__eq__, words, words[1:]))
        rest[8:11] = (len(raw) - n) / n / 20, len(counts) / n, top / n
        rest[13:15] = np.sqrt(again / n), sum(map(bytes.isalpha, words)) / n
    rest[11:13] = 1 - len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)) / 10
    out[N_SHARES:] = hashed(raw, words)
    return out


class Network:
    """A logistic output over one hidden layer of the first n_deep inputs, and over the others as they are; fitted by Adam on
    whole batches. The seed fixes everything."""

    def __init__(self, n_in: int, hidden: int, seed: int, n_deep: int | None = None):
        self.n_deep = n = n_in if n_deep is None else n_deep
        r = np.random.default_rng(seed)
        start = [r.normal(0, 1 / np.sqrt(n), (n, hidden)), np.zeros(hidden), r.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(n_in - n), np.zeros(1)]
        self.p = [p.astype(np.float32) for p in start]

    def margin(self, x: np.ndarray) -> np.ndarray:
        w, b, v, u, c = self.p
        return np.tanh(x[:, : self.n_deep] @ w + b) @ v + x[:, self.n_deep :] @ u + c[0]

    def gradient(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        w, b, v, *_ = self.p
        deep, wide = x[:, : self.n_deep], x[:, self.n_deep :]
        h = np.tanh(deep @ w + b)
        back = slope[:, None] * v * (1 - h * h)
        return [deep.T @ back, back.sum(axis=0), h.T @ slope, wide.T @ slope, slope.sum(keepdims=True)]

    def fit(self, slopes, x: np.ndarray, steps: int, rate: float = 0.02, decay: float = 1e-4) -> None:
        m, s = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for t in range(1, steps + 1):
            for k, g in enumerate(self.gradient(x, slopes(self.margin(x)).astype(np.float32))):
                g = g + decay * self.p[k]
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> float:
    """The share of positives among the unlabelled, from how a P-against-U classifier scores positives that it did not see.

    Where only positives lie, its odds of P are n_P / (prior * n_U). Each half of the positives is judged by a classifier that saw the
    other half.
    """
    found = []
    for k in (0, 1):
        seen, held = positive[k::2], positive[1 - k :: 2]
        if not len(seen) or not len(held):
            seen = held = positive
        x, y = np.concatenate([seen, unlabelled]), np.concatenate([np.ones(len(seen)), np.zeros(len(unlabelled))])
        net = Network(x.shape[1], 4, seed)
        net.fit(lambda z, y=y: (_sigmoid(z) - y) / len(y), x, 150)
        g = _sigmoid(net.margin(held))
        found.append(np.median((1 - g) / g) * len(seen) / len(unlabelled))
    return float(np.clip(np.mean(found), 0.05, 0.98))


def cautious(prior: float, n: int, errors: float = 1.5) -> float:
    """The prior less some standard errors of a share of n: one that is too high makes the risk call negatives positive."""
    return max(0.05, prior - errors * float(np.sqrt(prior * (1 - prior) / n)))


def pu_risk(z_positive: np.ndarray, z_unlabelled: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk of margins, with logistic loss."""
    rest = np.logaddexp(0, z_unlabelled).mean() - prior * np.logaddexp(0, z_positive).mean()
    return float(prior * np.logaddexp(0, -z_positive).mean() + max(0.0, rest))


def pu_slopes(z: np.ndarray, n_p: int, prior: float) -> np.ndarray:
    """The slope of pu_risk by each margin, positives first; while the risk's negative part is below 0, that part is stepped back."""
    n_u, p = len(z) - n_p, _sigmoid(z)
    loss = np.logaddexp(0, z)  # of calling it negative
    minus = np.concatenate([np.full(n_p, -prior / n_p), np.full(n_u, 1 / n_u)]) * p
    if loss[n_p:].mean() < prior * loss[:n_p].mean():
        return -minus
    return minus + np.concatenate([prior / n_p * (p[:n_p] - 1), np.zeros(n_u)])


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, hidden: int = 12, seed: int = 0, n_deep: int | None = None) -> Network:
    """Minimise the non-negative risk."""
    net = Network(positive.shape[1], hidden, seed, n_deep)
    net.fit(lambda z: pu_slopes(z, len(positive), prior), np.concatenate([positive, unlabelled]), steps)
    return net


def held_out(key: Column, folds: int = 5) -> Column:
    """Rows that no fit may see: crc32 of doc_id as text divides by folds. A null doc_id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t.as_py()).tobytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["positive", "features"])


def fit(docs: DataFrame, labels: DataFrame, max_positives: int = 4000, max_unlabelled: int = 8000, text: str = "text", key: str = "doc_id", label: str = "quality"):
    """A scoring function on feature matrices, or None if there is no positive to learn from."""
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    usable = labels.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label")).where("id is not null and label is not null")
    usable = usable.where(~held_out(F.col("id")))
    # at most max_positives ids: the bound of what is broadcast
    trusted = usable.where("label = 1").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_positives)
    rate = max_unlabelled / max(own.count(), 1)
    drawn = F.pmod(F.xxhash64("text", F.lit("unlabelled"), "id"), F.lit(2**40)) < F.lit(int(min(1.0, rate) * 2**40))
    picked = own.join(F.broadcast(trusted.withColumn("trusted", F.lit(True))), "id", "left")
    picked = picked.select(F.coalesce("trusted", F.lit(False)).alias("positive"), (drawn & ~held_out(F.col("id"))).alias("drawn"), "text").where("positive or drawn")
    # a trusted positive that is drawn as well counts on both sides
    picked = picked.select(F.explode(F.filter(F.array(F.when(F.col("positive"), True), F.when(F.col("drawn"), False)), lambda v: v.isNotNull())).alias("positive"), "text")
    rows = picked.mapInArrow(_featurise, "positive boolean, features binary").collect()
    rows.sort(key=lambda r: (r.positive, bytes(r.features)))
    read = lambda side: np.array([np.frombuffer(r.features, np.float16) for r in rows if r.positive == side], np.float32).reshape(-1, N_FEATURES)
    positive, unlabelled = read(True), read(False)
    if not len(positive) or not len(unlabelled):
        return None
    centre = unlabelled.mean(axis=0)
    scale = np.concatenate([unlabelled[:, :N_SHARES].std(axis=0) + 0.02, np.full(N_HASHED, 0.25, np.float32)])
    positive, unlabelled = (positive - centre) / scale, (unlabelled - centre) / scale
    positive = positive[np.random.default_rng(1).permutation(len(positive))]
    prior = cautious(estimate_prior(positive[:, :N_SHARES], unlabelled[:, :N_SHARES]), min(len(positive), len(unlabelled)))
    net = fit_pu(positive, unlabelled, prior, n_deep=N_SHARES)
    net.p = [p.astype(np.float64) for p in net.p]
    return centre.astype(np.float64), scale.astype(np.float64), net, prior


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", into: str = "score", **options) -> DataFrame:
    """docs with one more column `into`: a score from 0 to 1, higher where quality 1 is likelier.

    Equal texts have equal scores; null and empty texts are scored like any other. Without usable positives
    every score is 0.5. Labels of held-out rows, null labels and labels of unknown documents are not used;
    repeated rows are scored one by one; an empty table stays empty; other columns stay as they are, and one
    named `into` is replaced.
    """
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, text=text, key=key, **options)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.full(len(texts), 0.5))
        centre, scale, net, _ = model
        # row by row: a product of many rows is summed in an order that depends on their number
        margins = [net.margin(((features(t.as_py()) - centre) / scale)[None, :])[0] for t in texts]
        return pa.array(_sigmoid(np.array(margins, np.float64)))

    return docs.withColumn(into, scored(F.col(text)))
