"""Words of whole texts as arrays: byte ranges and 64-bit hashes, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The six white-space bytes that part words.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _series(n: int, seed: int) -> np.ndarray:
    """A fixed pseudo-random sequence (splitmix)."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers evenly; one to one."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BYTE = _series(256, 11)
_PLACE = _series(1 << 16, 12) | np.uint64(1)


def utf8(text: str | None, lower: bool = False) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.translate(_LOWER) if lower else raw


def bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte string."""
    solid = ~_SPACE[np.frombuffer(raw, np.uint8)]
    step = np.diff(np.r_[False, solid, False].astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _hash_slice(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8)
    solid = ~_SPACE[flat]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64)
    of = np.cumsum(first) - 1
    place = np.arange(len(flat)) - starts[np.maximum(of, 0)]
    with np.errstate(over="ignore"):
        value = _BYTE[flat] * _PLACE[place & 0xFFFF]
        value[~solid] = 0
        return mix(np.add.reduceat(value, starts))


def hashes(raw: bytes) -> np.ndarray:
    """Hash of each word of a byte string."""
    if len(raw) <= SLICE:
        return _hash_slice(raw)
    out, lo = [], 0
    while lo < len(raw):
        hi = min(lo + SLICE, len(raw))
        while hi < len(raw) and raw[hi] not in SPACE_BYTES:
            hi += 1
        out.append(_hash_slice(raw[lo:hi]))
        lo = hi
    return np.concatenate(out)


def grouped(texts: list[str | None], lower: bool, size: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashes of the words of many texts, group by group: number of the first text, hashes, words per text."""
    lo = 0
    while lo < len(texts):
        raws, total = [], 0
        while lo + len(raws) < len(texts) and (not raws or total < size):
            raws.append(utf8(texts[lo + len(raws)], lower))
            total += len(raws[-1]) + 1
        counts = np.empty(len(raws), np.int64)
        flat = b"\n".join(raws)
        words = hashes(flat)
        solid = ~_SPACE[np.frombuffer(flat, np.uint8)]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        ends = np.cumsum([len(r) + 1 for r in raws])
        before = np.r_[0, np.cumsum(first)]
        upto = before[np.minimum(ends, len(flat))]
        counts[:] = np.diff(np.r_[0, upto])
        yield lo, words, counts
        lo += len(raws)
