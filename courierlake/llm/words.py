"""Hashes of words and of runs of words, for whole Arrow columns of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_gap = np.isin(np.arange(256), [32, *range(9, 14)])
#: Hash values of bytes, and the base of the polynomial by which a word's bytes are summed.
_byte = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def mixed_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all ``texts``, with A-Z in lower case, and where each text's words start among them (with the end)."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    solid = ~_gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = solid & (edge[:-1] | np.append(True, ~solid[:-1]))
    last = solid & (edge[1:] | np.append(~solid[1:], True))
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power = np.full(len(data), BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte[_lower[data]] * power, out=sums[1:])
    back = np.full(int(start[-1]) + 1 if len(start) else 1, pow(BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mixed_bits((sums[end] - sums[start]) * back[start]), np.searchsorted(start, off)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` word hashes."""
    n = max(0, len(h) - k + 1)
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = (s ^ h[i : i + n]) * np.uint64(BASE)
        s ^= s >> np.uint64(29)
    return mixed_bits(s)
