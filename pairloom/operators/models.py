"""Forward passes of the pooling networks, in NumPy on the executors. Weights are seeded or loaded as plain arrays;
their size is that of the model, fixed by its widths, and they travel with the task's closure."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Weights = dict[str, np.ndarray]


def linear(r: np.random.Generator, n_in: int, n_out: int) -> list[np.ndarray]:
    bound = 1 / math.sqrt(n_in)
    return [r.uniform(-bound, bound, (n_in, n_out)), r.uniform(-bound, bound, n_out)]


def layer_norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + eps)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, heads: int, shut: np.ndarray | None = None) -> np.ndarray:
    """Scaled dot products in `heads` slices of the width; shut marks pairs (query, key) that must not see each other."""
    width = q.shape[1] // heads
    split = lambda x: x.reshape(len(x), heads, width).transpose(1, 0, 2)
    scores = split(q) @ split(k).transpose(0, 2, 1) / math.sqrt(width)
    if shut is not None:
        scores = np.where(shut[None], -np.inf, scores)
    return (softmax(scores) @ split(v)).transpose(1, 0, 2).reshape(len(q), -1)


@dataclass
class Layer:
    """One post-norm transformer layer: attention (to itself, and in a decoder to a memory too), then a ReLU network."""

    width: int
    heads: int
    hidden: int
    seed: int
    memory: bool = False
    w: Weights = field(default_factory=dict)

    def __post_init__(self):
        r = np.random.default_rng(self.seed)
        for name in ["self", "memory"][: 1 + self.memory]:
            for part in "qkvo":
                self.w[f"{name}_{part}"], self.w[f"{name}_{part}_b"] = linear(r, self.width, self.width)
        self.w["up"], self.w["up_b"] = linear(r, self.width, self.hidden)
        self.w["down"], self.w["down_b"] = linear(r, self.hidden, self.width)

    def _attend(self, name: str, x: np.ndarray, to: np.ndarray, shut: np.ndarray | None) -> np.ndarray:
        p = lambda part, a: a @ self.w[f"{name}_{part}"] + self.w[f"{name}_{part}_b"]
        return p("o", attention(p("q", x), p("k", to), p("v", to), self.heads, shut))

    def __call__(self, x: np.ndarray, shut: np.ndarray | None = None, memory: np.ndarray | None = None) -> np.ndarray:
        x = layer_norm(x + self._attend("self", x, x, shut))
        if memory is not None:
            x = layer_norm(x + self._attend("memory", x, memory, None))
        return layer_norm(x + np.maximum(0, x @ self.w["up"] + self.w["up_b"]) @ self.w["down"] + self.w["down_b"])


class ResidualBlock:
    def __init__(self, n_in: int, n_out: int, seed: int):
        r = np.random.default_rng(seed)
        self.skip = linear(r, n_in, n_out) if n_in != n_out else None
        self.one, self.two = linear(r, n_in, n_out), linear(r, n_out, n_out)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        skip = x if self.skip is None else x @ self.skip[0] + self.skip[1]
        h = np.maximum(0, layer_norm(x) @ self.one[0] + self.one[1])
        return np.maximum(0, layer_norm(h) @ self.two[0] + self.two[1] + skip)


class LinearAggregator:
    """The sum of the vectors, normalised, through a linear layer and ReLU."""

    def __init__(self, n_in: int, n_out: int, seed: int = 0):
        self.out = linear(np.random.default_rng(seed), n_in, n_out)

    def __call__(self, vectors: np.ndarray, shut: np.ndarray | None = None) -> np.ndarray:
        return np.maximum(0, layer_norm(vectors.sum(axis=0)) @ self.out[0] + self.out[1])


class TransformerAggregator:
    """Transformer layers over a domain's vectors, their sum, then normalisation or residual blocks, a linear layer
    and ReLU. Each domain is pooled on its own, so no padding can enter the sum."""

    def __init__(self, width: int, heads: int = 4, hidden: int = 128, layers: int = 2, blocks: int = 0, out: int | None = None, seed: int = 0):
        self.layers = [Layer(width, heads, hidden, seed + k) for k in range(layers)]
        out = out or width
        sizes = [width] + [out] * blocks
        self.blocks = [ResidualBlock(a, b, seed + 100 + k) for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))]
        self.out = linear(np.random.default_rng(seed + 200), sizes[-1], out)

    def __call__(self, vectors: np.ndarray, shut: np.ndarray | None = None) -> np.ndarray:
        x = vectors
        for layer in self.layers:
            x = layer(x, shut)
        x = x.sum(axis=0)
        for block in self.blocks:
            x = block(x)
        x = x if self.blocks else layer_norm(x)
        return np.maximum(0, x @ self.out[0] + self.out[1])


class SequenceAutoencoder:
    """Tokens to a latent vector of length 1, and back to logits for each place."""

    def __init__(self, symbols: int = 29, width: int = 32, latent: int = 16, heads: int = 4, layers: int = 2, hidden: int = 64, longest: int = 2048, blocks: int = 0, seed: int = 0):
        r = np.random.default_rng(seed)
        self.table, self.queries = r.normal(size=(symbols, width)), r.normal(size=(longest, width))
        self.table[0] = 0
        self.encoder = [Layer(width, heads, hidden, seed + 1 + k) for k in range(layers)]
        self.decoder = [Layer(width, heads, hidden, seed + 101 + k, memory=True) for k in range(layers)]
        self.blocks = [ResidualBlock(width, width, seed + 201 + k) for k in range(blocks)]
        self.to_latent, self.from_latent, self.to_logits = linear(r, width, latent), linear(r, latent, width), linear(r, width, symbols)
        rate = np.exp(np.arange(0, width, 2) * (-math.log(10000.0) / width))
        self.places = np.zeros((longest, width))
        self.places[:, 0::2], self.places[:, 1::2] = np.sin(np.arange(longest)[:, None] * rate), np.cos(np.arange(longest)[:, None] * rate)

    def encode(self, tokens: np.ndarray) -> np.ndarray:
        pad = tokens == 0
        x = self.table[tokens] + self.places[: len(tokens)]
        shut = np.broadcast_to(pad, (len(tokens), len(tokens))) if pad.any() and not pad.all() else None
        for layer in self.encoder:
            x = layer(x, shut)
        total = (x * ~pad[:, None]).sum(axis=0)
        if self.blocks:
            for block in self.blocks:
                total = block(total)
            latent = np.maximum(0, total @ self.to_latent[0] + self.to_latent[1])
        else:
            latent = layer_norm(total / max(1, (~pad).sum())) @ self.to_latent[0] + self.to_latent[1]
        return latent / max(np.linalg.norm(latent), 1e-12)

    def decode(self, latent: np.ndarray, length: int) -> np.ndarray:
        memory, x = (latent @ self.from_latent[0] + self.from_latent[1])[None], self.queries[:length]
        for layer in self.decoder:
            x = layer(x, None, memory)
        return x @ self.to_logits[0] + self.to_logits[1]


NETWORKS = {"linear": LinearAggregator, "transformer": TransformerAggregator}


def network(name: str, width: int, **settings: int) -> Callable:
    """The named pooling network for vectors of a width; a linear one is as wide as its input unless told otherwise."""
    if name not in NETWORKS:
        raise ValueError(f"no network {name}; there are {', '.join(sorted(NETWORKS))}")
    if name == "linear":
        return LinearAggregator(width, settings.pop("out", width), **settings)
    return NETWORKS[name](width, **settings)


def _slots(part, name: str = "") -> Iterator[tuple[str, object, object]]:
    """(name, holder, key) of each array of a network, down through its parts."""
    inside = enumerate(part) if isinstance(part, list) else (part if isinstance(part, dict) else vars(part)).items()
    for key, value in inside:
        at = f"{name}.{key}" if name else str(key)
        if isinstance(value, np.ndarray):
            yield at, part, key
        elif isinstance(value, list | dict) or hasattr(value, "__dict__"):
            yield from _slots(value, at)


def _at(holder, key) -> np.ndarray:
    return holder[key] if isinstance(holder, list | dict) else getattr(holder, key)


def weights_of(network: Callable) -> Weights:
    """A network's arrays by name."""
    return {name: _at(holder, key) for name, holder, key in _slots(network)}


def with_weights(network: Callable, weights: Weights) -> Callable:
    """The network with these arrays in place of its own; names and shapes have to be the same."""
    own = weights_of(network)
    wrong = sorted(set(own) ^ set(weights)) or sorted(n for n in own if own[n].shape != weights[n].shape)
    if wrong:
        raise ValueError(f"weights do not fit the network: {', '.join(wrong)}")
    for name, holder, key in list(_slots(network)):
        if isinstance(holder, list | dict):
            holder[key] = weights[name]
        else:
            setattr(holder, key, weights[name])
    return network


def save_weights(network: Callable, path: str) -> None:
    """One file of plain arrays, which load_weights reads."""
    with open(path, "wb") as f:
        np.savez(f, **weights_of(network))


def load_weights(path: str) -> Weights:
    with np.load(path, allow_pickle=False) as f:
        return {name: f[name] for name in f.files}


def predict(rows: DataFrame, network: Callable, key: str, value: str, mask: str | None = None) -> DataFrame:
    """(key, embedding, error): the network on each row's array; a failing row has its error and no embedding, and a
    null array neither."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, v, m in zip(b[key], b[value], b[mask] if mask else [None] * len(b), strict=True):
                try:
                    array = None if v is None else np.array([np.asarray(x) for x in v])
                    shut = None if m is None else np.array([np.asarray(x) for x in m], bool)
                    made = None if array is None else network(array) if shut is None else network(array, shut)
                    out.append((k, None if made is None else made.astype(float).tolist(), None))
                except Exception as e:  # the row's error is its result
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "embedding", "error"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, value, *([mask] if mask else [])).mapInPandas(run, f"{key} {kind}, embedding array<double>, error string")
