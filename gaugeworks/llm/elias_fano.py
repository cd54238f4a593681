"""Monotone sequences in Elias-Fano form, and files of arrays that are mapped into memory."""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

import numpy as np

_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_SELECT = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)


def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a sorted sequence of integers below ``universe``: packed low bits, unary high bits, zero counts per word."""
    values, n = values.astype(np.uint64), len(values)
    low_bits = max(0, (int(universe) // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    zeros = int((int(universe) - 1) >> low_bits) + 1 if universe else 1
    n_bits = n + zeros
    flags = np.zeros(-(-n_bits // 64) * 64, np.uint8)
    flags[np.arange(n) + high] = 1
    flags[n_bits:] = 1  # no zero beyond the last bucket
    upper = np.packbits(flags, bitorder="little").view(np.uint64)
    per_word = 64 - flags.reshape(-1, 64).sum(axis=1, dtype=np.int64)
    lows = np.zeros(-(-n * low_bits // 64) + 1, np.uint64)
    if low_bits:
        low = values & np.uint64((1 << low_bits) - 1)
        at = np.arange(n, dtype=np.int64) * low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(lows, word, low << shift)
        over = (shift + np.uint64(low_bits)) > np.uint64(64)
        np.bitwise_or.at(lows, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
    return {"lows": lows, "upper": upper, "zeros": np.cumsum(per_word) - per_word, "shape": np.array([n, low_bits, zeros], np.int64)}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.lows, self.upper, self.zeros = arrays["lows"], arrays["upper"], arrays["zeros"]
        self.n, self.low_bits, self.buckets = (int(x) for x in arrays["shape"])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.lows[word] >> shift
        over = np.flatnonzero(shift + np.uint64(self.low_bits) > np.uint64(64))
        out[over] |= self.lows[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low_bits) - 1)

    @staticmethod
    def _in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th set bit of each word."""
        parts = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(_POP[parts], axis=1, dtype=np.int64)
        byte = (upto <= k[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        before = np.where(byte > 0, upto[rows, np.maximum(byte - 1, 0)], 0)
        return byte * 8 + _SELECT[parts[rows, byte], k - before]

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return word * 64 + self._in_word(~self.upper[word], k - self.zeros[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(ones, i, side="right") - 1
        at = word * 64 + self._in_word(self.upper[word], i - ones[word])
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where it is not in the sequence: successor search in the bucket of its high bits."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        inside = high < self.buckets
        high = np.where(inside, high, 0)
        end = self._zero(high) - high
        start = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - (high - 1), 0)
        lo, hi = start.copy(), end.copy()
        low = values & np.uint64((1 << self.low_bits) - 1)
        for _ in range(int((hi - lo).max()).bit_length()):
            mid = (lo + hi) >> 1
            less = (lo < hi) & (self._low(np.minimum(mid, self.n - 1)) < low)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.minimum(mid, hi))
        safe = np.minimum(lo, self.n - 1)
        return np.where(inside & (lo < end) & (self._low(safe) == low), lo, -1)


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else folder.removeprefix("file:"))


def write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays as one file of a shared folder; a second attempt replaces the first."""
    system, root = _open(folder)
    system.create_dir(root)
    head = json.dumps({k: [a.dtype.str, len(a)] for k, a in arrays.items()}).encode()
    head += b" " * (-(len(head) + 8) % 64)
    part = f"{root}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            raw = np.ascontiguousarray(a).tobytes()
            out.write(raw + bytes(-len(raw) % 64))
    system.move(part, f"{root}/{name}")


@lru_cache(maxsize=4096)
def read(folder: str, name: str) -> dict[str, np.ndarray]:
    """Arrays of a file: mapped where the folder is a file system of the machine, else read."""
    from pyarrow import fs

    system, root = _open(folder)
    if isinstance(system, fs.LocalFileSystem):
        raw = np.memmap(f"{root}/{name}", np.uint8, "r")
    else:
        with system.open_input_file(f"{root}/{name}") as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    at, out = 8 + size, {}
    for k, (kind, n) in json.loads(raw[8:at].tobytes()).items():
        n_bytes = n * np.dtype(kind).itemsize
        out[k] = np.asarray(raw[at : at + n_bytes]).view(kind)
        at += n_bytes + (-n_bytes % 64)
    return out
