"""SentencePiece encoding with the n best segmentations, and decoding.

A segmentation's score is the sum of its pieces' scores in the model, and the n best are those of greatest sums. For a BPE model
this is not what the model's own encoder gives: that merges pairs by rank, and the sum of its pieces is never greater. The lattice of a text falls apart where
no piece holds two neighbouring characters together; such parts (mostly words) recur, so a worker keeps what it
found for them. For each part the forward Viterbi pass gives the best segmentation and the score of the second.
Only the n - 1 parts that lose least can differ from the best in the n best of the text; in these, a backward
A* search, with the forward scores as exact heuristic, yields the alternatives in order.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import bounded_batches

SPACE = "▁"
#: A character that is no piece is spelled by its bytes, for this much less than the lowest piece.
SPELL_PENALTY = 10.0
CACHE_PARTS = 1 << 19
NOTHING = float("-inf")


class PieceModel:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain}
        self.text = {i: p.replace(SPACE, " ").encode() for p, (i, _) in self.pieces.items()}
        spelled = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.spelled = [spelled.get(b, sp.unk_id()) for b in range(256)]
        self.text |= {i: bytes([b]) for b, i in spelled.items()}
        #: the pieces' trie: a dict a node, its children by character, and at "" the (id, score) of the piece that ends there
        self.trie: dict = {}
        for p, own in self.pieces.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = own
        used = [s for _, s in self.pieces.values() if s > -1e8]
        self.spell_score = min(used) - SPELL_PENALTY
        # which characters may stand next to each other within a piece
        inner = sorted({c for p in self.pieces if len(p) > 1 for c in p})
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.joined = np.zeros((len(inner) + 1,) * 2, bool)
        for p in self.pieces:
            for a, b in zip(p, p[1:], strict=False):
                self.joined[self.kind[ord(a)], self.kind[ord(b)]] = True
        self.joined[0, :] = self.joined[:, 0] = False
        self.cache: dict[str, tuple[bytes, int, float, float]] = {}
        self.ways: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}

    def parts(self, text: str) -> list[str]:
        """The independent parts of a text's lattice, in order; a space stands before the text and is shown as SPACE."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        kinds = self.kind[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        cuts = (np.flatnonzero(~self.joined[kinds[:-1], kinds[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def _spell(self, c: str) -> tuple[int, ...]:
        return tuple(self.spelled[b] for b in c.encode())

    def _edges(self, part: str, i: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
        """(end, ids, score) of the lattice's edges from position i; a character that is no piece is spelled."""
        single = self.pieces.get(part[i])
        yield (i + 1, (single[0],), single[1]) if single else (i + 1, self._spell(part[i]), self.spell_score)
        node = self.trie.get(part[i])
        for j in range(i + 1, len(part)):
            node = node and node.get(part[j])
            if not node:
                return
            if "" in node:
                yield j + 1, (node[""][0],), node[""][1]

    def best(self, part: str) -> tuple[bytes, int, float, float]:
        """(ids as 4-byte integers, how many, score, loss of the second best) by the forward Viterbi pass.

        Among equal scores the smaller last id wins.
        """
        n, trie = len(part), self.trie
        first, second, last, back = [NOTHING] * (n + 1), [NOTHING] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        first[0] = 0.0
        for i, c in enumerate(part):
            a, b, j, node = first[i], second[i], i + 1, trie.get(c)
            p = node and node.get("") or (self.spelled[c.encode()[0]], self.spell_score)
            while True:
                if p:
                    v, top = a + p[1], first[j]
                    if v > top:
                        w = b + p[1]
                        second[j] = w if w > top else top
                        first[j], last[j], back[j] = v, p[0], i
                    elif v == top and p[0] < last[j]:
                        second[j], last[j], back[j] = top, p[0], i
                    elif v > second[j]:
                        second[j] = v
                if j == n or not node:
                    break
                node = node.get(part[j])
                if not node:
                    break
                p = node.get("")
                j += 1
        flat, at = [], n
        while at:
            i = back[at]
            if at > i + 1 or part[i] in self.pieces:
                flat.append(last[at])
            else:
                flat.extend(reversed(self._spell(part[i])))
            at = i
        flat.reverse()
        return pack(f"<{len(flat)}i", *flat), len(flat), first[n], first[n] - second[n]

    def alternatives(self, part: str, n_best: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a part: A* from the end; the forward scores are what is still to come, exactly.

        Equal scores come in order of their ids read from the end.
        """
        known = self.ways.get((part, n_best))
        if known is not None:
            return known
        n = len(part)
        forward, into = [0.0] + [NOTHING] * n, [[] for _ in range(n + 1)]
        for i in range(n):
            for j, ids, s in self._edges(part, i):
                forward[j] = max(forward[j], forward[i] + s)
                into[j].append((i, ids, s))
        heap, found = [(-forward[n], (), n, 0.0)], []
        while heap and len(found) < n_best:
            f, path, at, behind = heapq.heappop(heap)
            if not at:
                found.append((-f, [i for ids in reversed(path) for i in ids]))
            for i, ids, s in into[at]:
                heapq.heappush(heap, (-(forward[i] + behind + s), (*path, ids), i, behind + s))
        if len(self.ways) >= CACHE_PARTS >> 3:
            self.ways.clear()
        if n <= 64:
            self.ways[part, n_best] = found
        return found

    def _learn(self, part: str) -> tuple[bytes, int, float, float]:
        if len(self.cache) >= CACHE_PARTS:
            self.cache.clear()
        got = self.best(part)
        if len(part) <= 64:
            self.cache[part] = got
        return got

    def encode(self, text: str, n_best: int) -> tuple[np.ndarray, float, list[tuple[float, list[tuple[int, int, list[int]]]]]]:
        """(ids, score, [(score, edits)] of the 2nd to n-th best); an edit (at, drop, put) replaces ids[at : at + drop].

        Equal scores come in order of the parts that they change, then of the alternatives within.
        """
        parts = self.parts(text)
        get, learn = self.cache.get, self._learn
        known = [get(p) or learn(p) for p in parts]
        ids = np.frombuffer(b"".join([k[0] for k in known]), "<i4")
        total = float(sum([k[2] for k in known]))
        if n_best < 2 or not parts:
            return ids, total, []
        loss = np.array([k[3] for k in known])
        near = np.argsort(loss, kind="stable")[: n_best - 1] if len(loss) < 64 else self._least(loss, n_best - 1)
        near = sorted(int(k) for k in near if np.isfinite(loss[k]))
        starts = np.cumsum([k[1] for k in known])
        ways: list[tuple[float, tuple]] = [(0.0, ())]
        for k in near:
            (top, _), *rest = self.alternatives(parts[k], n_best)
            at, drop = int(starts[k]) - known[k][1], known[k][1]
            more = [(lost + top - s, (*edits, (at, r, drop, tuple(put)))) for lost, edits in ways for r, (s, put) in enumerate(rest)]
            ways = sorted([*ways, *more], key=lambda x: (x[0], [e[:2] for e in x[1]]))[:n_best]
        return ids, total, [(total - lost, [(at, drop, list(put)) for at, _, drop, put in edits]) for lost, edits in ways[1:]]

    @staticmethod
    def _least(loss: np.ndarray, n: int) -> np.ndarray:
        edge = np.partition(loss, n - 1)[n - 1]
        at = np.flatnonzero(loss <= edge)
        return at[np.argsort(loss[at], kind="stable")[:n]]

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids without the space before it; control ids have no text."""
        get = self.text.get
        text = b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@functools.cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


EDIT = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("drop", T.IntegerType()), T.StructField("put", T.ArrayType(T.IntegerType()))])
WAY = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("edits", T.ArrayType(EDIT))])
ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType()), T.StructField("others", T.ArrayType(WAY))])
ARROW_EDIT = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("put", pa.list_(pa.int32()))])
ARROW_WAY = pa.struct([("score", pa.float64()), ("edits", pa.list_(ARROW_EDIT))])


def encode_column(text: Column, path: str, n_best: int) -> Column:
    """struct<ids, score, others>: the best segmentation, and the 2nd to n-th as scores and edits of it."""

    @F.arrow_udf(ENCODED)
    def encoded(texts: pa.Array) -> pa.Array:
        m = model(path)
        ids, scores, others = [], [], []
        for t in texts:
            i, s, o = m.encode(t.as_py() or "", n_best)
            ids.append(i)
            scores.append(s)
            others.append([{"score": w, "edits": [{"at": a, "drop": d, "put": p} for a, d, p in edits]} for w, edits in o])
        offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(scores, pa.float64()), pa.array(others, pa.list_(ARROW_WAY))], names=["ids", "score", "others"])

    return encoded(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of an array of ids; null stays null."""

    @F.arrow_udf(T.StringType())
    def decoded(arrays: pa.Array) -> pa.Array:
        m = model(path)
        return pa.array([m.decode(a.as_py()) if a.is_valid else None for a in arrays], pa.string())

    return decoded(ids)


def encode_nbest(docs: DataFrame, path: str, n_best: int = 4, text: str = "text", into: str = "encoded") -> DataFrame:
    """docs with one more column `into`: struct<ids, score, others>.

    A null or empty text has no ids, score 0 and no others; a text with fewer than n_best segmentations has
    fewer others. Equal texts give equal results. An empty table stays empty; other columns stay as they are, and
    one named `into` is replaced.
    """
    bounded_batches(docs.sparkSession)
    return docs.withColumn(into, encode_column(F.col(text), path, n_best))


DIGEST = T.StructType([T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("others", T.StringType()), T.StructField("decoded_crc32", T.LongType())])


def digest_column(encoded: Column, path: str) -> Column:
    """Figures of an encoded column: counts, checksums of the ids and of the decoded text, and the others as text
    `loss:at+drop>ids,...`."""

    @F.arrow_udf(DIGEST)
    def digest(column: pa.Array) -> pa.Array:
        m, ids = model(path), column.field("ids")
        offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        scores = column.field("score").to_numpy(zero_copy_only=False)
        out = []
        for k, others in enumerate(column.field("others").to_pylist()):
            own = flat[offsets[k] : offsets[k + 1]]
            ways = ";".join(f"{scores[k] - w['score']:g}:" + ",".join(f"{e['at']}+{e['drop']}>{'.'.join(map(str, e['put']))}" for e in w["edits"]) for w in others)
            out.append((len(own), zlib.crc32(own.astype("<i4").tobytes()), scores[k], ways, zlib.crc32(m.decode(own.tolist()).encode())))
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int64()]
        return pa.StructArray.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], names=[f.name for f in DIGEST.fields])

    return digest(encoded)
