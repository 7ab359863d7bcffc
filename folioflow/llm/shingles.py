"""Shingle sets as sorted 64-bit hashes, and parity sketches of them."""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_ODD = _U(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _ODD, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[str | None], k: int = 3) -> list[np.ndarray]:
    """The distinct k-word shingles of each text as sorted hashes. Words are runs without space, tab, line feed,
    vertical tab, form feed or return, with A-Z lower-cased; fewer than k words count as one shingle, none as none."""
    raw = [(t or "").encode("utf-8").lower() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    if len(starts):
        ends = np.flatnonzero(edge == 1)
        lengths = ends - starts
        begin = np.cumsum(lengths) - lengths
        offset = np.arange(lengths.sum()) - np.repeat(begin, lengths)
        words = mix64(np.add.reduceat(_BYTES[data[~space]] * _powers(int(lengths.max()))[offset], begin) + lengths.astype(np.uint64))
    else:
        words = np.zeros(0, dtype=np.uint64)
    joined = words[: max(0, len(words) - k + 1)].copy()
    for i in range(1, k):
        joined = mix64(joined * _ODD + words[i : len(words) - k + 1 + i]) if len(joined) else joined
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(joined[a : b - k + 1]))
        elif b > a:
            whole = words[a : a + 1] + _U(b - a)
            for i in range(a + 1, b):
                whole = mix64(whole * _ODD + words[i : i + 1])
            out.append(mix64(whole))
        else:
            out.append(words[:0])
    return out


# Words of 64 bits of a sketch, and the set size from which a set has one of that length; a link to a set of 1.25 times the
# size or less never leaves both sides without a common length that suits them.
SKETCHES = ((8, 0), (64, 320), (512, 3200))


def sketch(shingles: np.ndarray, words: int = 8) -> np.ndarray:
    """Parities of the shingles by 64 x words cells. The bits in which two sketches of one length differ are at most as many as
    the shingles in which the sets differ."""
    cell = np.bincount((mix64(shingles + np.uint64(3)) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(cell.astype(np.uint8)).view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
