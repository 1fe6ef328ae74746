"""Word shingles of texts as sorted distinct 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

SIZE = 5
_A = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(71)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


#: Bytes of a word that are hashed by place; what follows is hashed on its own.
SHORT = 64
_PLACE = np.append(_powers(SHORT), np.uint64(0))


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts end to end, the text each is of, and each one's byte range.

    Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z. A word's hash is a
    polynomial over random byte values, then mixed.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    inside = ~space
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.searchsorted(first, starts, side="right") - 1
    if not len(starts):
        return np.zeros(0, np.uint64), owner, starts, ends
    length = ends - starts
    # each byte's value times the power of its place in the word, added up by word
    word = np.cumsum(inside & ~np.concatenate([[False], inside[:-1]]), dtype=np.int32) - 1
    place = (np.arange(len(data), dtype=np.int32) - starts.astype(np.int32)[word]).clip(0, SHORT)
    values = np.where(inside, _BYTE[data], np.uint64(0))
    h = np.add.reduceat(values * _PLACE[place], starts)
    for i in np.flatnonzero(length > SHORT):
        tail = values[starts[i] + SHORT : ends[i]]
        p = _powers(len(tail))[::-1]
        with np.errstate(over="ignore"):
            h[i] = mix(h[i : i + 1])[0] * _STEP + (mix(tail + np.arange(len(tail), dtype=np.uint64) * _A) * p).sum(dtype=np.uint64)
    return mix(h + length.astype(np.uint64) * _A), owner, starts, ends


def join_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes."""
    n = len(w) - k + 1
    h = w[:n].copy()
    for j in range(1, k):
        h = mix(h * _STEP + w[j : j + n])
    return h


def sets(texts: list[bytes]) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its five-word shingles.

    Fewer words make one shingle of all; no words make none.
    """
    w, owner, _, _ = words(texts)
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    every = join_hashes(w, SIZE) if len(w) >= SIZE else np.zeros(0, np.uint64)
    out = []
    for i, n in enumerate(counts.tolist()):
        a = first[i]
        if n >= SIZE:
            x = np.sort(every[a : a + n - SIZE + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
        elif n:
            out.append(join_hashes(w[a : a + n], n) + np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
