"""Words of texts as 64-bit numbers, and rolling hashes over runs of words, a whole Arrow column at a time."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes whose powers are kept at hand; longer columns are hashed in spans of about this size.
SPAN = 1 << 19
#: Words of more bytes are hashed by BLAKE2b: a polynomial modulo 2^64 is weak on long regular strings.
LONG_WORD = 256

_BASE = 0x9E3779B97F4A7C15 | 1
_BLANKS = [0x20, 9, 10, 11, 12, 13]
_blank = np.zeros(256, bool)
_blank[_BLANKS] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_value = np.random.default_rng(2024).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the input (the finisher of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64, and of its inverse, from 0 to ``n`` at least."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SPAN + 1)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[:] = made
    return _powers[0], _powers[1]


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends. A null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, "<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """``hashes[first[i]:first[i + 1]]`` are the words of text ``i``; word ``j`` is ``data[starts[j]:ends[j]]``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Runs of bytes without ASCII blanks; ``lower`` turns A-Z to a-z before."""
    data, offsets = column_bytes(texts)
    data = _lower[data] if lower else data
    blank = _blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= blank[:-1]
    after[:-1] |= blank[1:]
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(~blank & after) + 1
    hashes = np.zeros(len(starts), np.uint64)
    cuts = [0, *(np.flatnonzero(np.diff(starts // SPAN)) + 1).tolist(), len(starts)]
    for a, b in zip(cuts, cuts[1:]):
        if b <= a:
            continue
        low, high = starts[a], ends[b - 1]
        up, down = powers(int(high - low))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_value[data[low:high]] * up[: high - low], out=sums[1:])
        hashes[a:b] = (sums[ends[a:b] - low] - sums[starts[a:b] - low]) * down[starts[a:b] - low]
    hashes = mixed(hashes ^ (ends - starts).astype(np.uint64))
    for j in np.flatnonzero(ends - starts > LONG_WORD):
        digest = hashlib.blake2b(data[starts[j] : ends[j]].tobytes(), digest_size=8).digest()
        hashes[j] = int.from_bytes(digest, "little")
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), data)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of the ``size`` words from each word on, for all words that have so many from there on."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + hashes[k : n + k]
    return mixed(out)
