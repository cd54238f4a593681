"""Public tokenizer files: vocabulary, merges and the text splitting that goes with them.

Only the file is read from the library's format; splitting and merging are done by the operators.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: The patterns of the two public tokenizers, as their files state them.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries a worker keeps of what it has worked out for a piece of text; a full table starts anew.
MEMO = 700_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [chars[b] for b in range(256)]


class Vocabulary:
    """Ids of single bytes, sorted pair keys with their rank and result, token strings, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        self.first = np.array([ids[c] for c in chars], np.uint32)
        self.last = np.array([ids[c + self.suffix] for c in chars], np.uint32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.uint64)
        right = np.array([ids[b] for _, b in pairs], np.uint64)
        made = np.array([ids[a + b] for a, b in pairs], np.uint32)
        keys = (left << np.uint64(32)) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], np.arange(len(pairs), dtype=np.int64)[order], made[order]
        self.by_rank = made
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)
