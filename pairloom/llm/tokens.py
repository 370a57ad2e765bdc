"""Byte-level BPE ids from a tokenizers JSON file."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import public_tokenizers
import tiktoken

#: Runs of white space (Unicode's White_Space, as the pattern has it) that are too long for the pattern's matcher, whose stack
#: grows with them.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself if printable Latin-1, else 256, 257, ... in byte order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def byte_bpe(path: str) -> tiktoken.Encoding:
    """The vocabulary of the JSON file with merges in order of id, which gives the ids that tokenizers gives
    (tests compare them), several times as fast. Strings of special tokens are ordinary text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _plain(bpe: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids, without a Python number for each; no special token is allowed, so that their strings are ordinary text."""
    return bpe.encode_to_numpy(text, disallowed_special=())


def encode(bpe: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a text. The pattern takes a run of white space, less its last character where something follows, as one
    piece; long runs are cut out by that rule and merged without the matcher."""
    if len(text) < 4096 or not (found := list(LONG_SPACE.finditer(text))):
        return _plain(bpe, text)
    ids, at = [], 0
    for m in found:
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += [_plain(bpe, text[at : m.start()]), np.array(bpe._encode_single_piece(text[m.start() : end]), np.uint32)]
        at = end
    return np.concatenate([*ids, _plain(bpe, text[at:])])
