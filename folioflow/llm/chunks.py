"""Content-defined chunking with a gear hash and normalised boundaries."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np


def _gear() -> np.ndarray:
    """One 32-bit value per byte, by mixing the byte's number."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: the sum of GEAR[byte] << age over the last 32 bytes, by doubling the window."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            more = h[:-k] << np.uint32(k)
            h[k:] += more
    return h


def cuts(raw: bytes, target: int = 64) -> list[int]:
    """Ends of the chunks of raw. A chunk has target / 4 to 4 * target bytes (the last may be shorter); up to the
    target size a boundary needs two bits more than a plain chunker of that size would ask, beyond it two less."""
    n = len(raw)
    if n == 0:
        return []
    low, high = target // 4, target * 4
    bits = max(3, target.bit_length() - 1)
    h = rolling(np.frombuffer(raw, dtype=np.uint8))
    loose = np.flatnonzero(h < np.uint32(1 << (32 - bits + 2)))
    strict = (loose[h[loose] < np.uint32(1 << (32 - bits - 2))] + 1).tolist()
    easy = (loose + 1).tolist()
    ends, start = [], 0
    while n - start > low:
        i = bisect_left(strict, start + low)
        if i < len(strict) and strict[i] < start + target:
            end = strict[i]
        else:
            i = bisect_left(easy, start + target)
            end = min(easy[i] if i < len(easy) else n, start + high, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends
