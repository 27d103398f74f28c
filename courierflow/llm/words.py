"""Words and word n-grams of whole texts as 64-bit numbers, vectorised with numpy.

A word is a maximal run of characters other than space, tab, line feed, vertical
tab, form feed and carriage return. All of these are single bytes, so the work is
done on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20  # bytes hashed at once; longer texts are cut at white space
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
_ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[0]
    x = (x ^ (x >> np.uint64(27))) * _ODD[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def blocks(data: np.ndarray, size: int = BLOCK) -> Iterator[np.ndarray]:
    """The bytes in blocks that no word crosses; a longer word is a longer block."""
    start = 0
    while start < len(data):
        stop = min(start + size, len(data))
        while stop < len(data):
            gaps = np.flatnonzero(SPACE[data[start:stop]])
            if len(gaps):
                stop = start + int(gaps[-1]) + 1
                break
            stop = min(stop + size, len(data))
        yield data[start:stop]
        start = stop


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, in bytes."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~SPACE[data]
    edges = np.flatnonzero(np.diff(solid))
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """One number per word, in order; ``lower`` folds A-Z."""
    found = []
    for block in blocks(data):
        starts, ends = spans(block)
        if len(starts) == 0:
            continue
        up, down = powers(max(len(block), BLOCK))
        values = (LOWER[block] if lower else block).astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(values * up[: len(block)], out=total[1:])
        found.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD[2]))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """One number per window of n consecutive words (none if there are fewer)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1]
    for k in range(1, n):
        out = mix(out * _ODD[2] + words[k : len(words) - n + 1 + k])
    return out


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct n-word shingles, sorted; a shorter text is one shingle as a whole."""
    words = word_hashes(as_bytes(text), lower=True)
    if 0 < len(words) < n:
        # the length sets short wholes apart from shingles
        return mix(grams(words, len(words)) + np.uint64(len(words)))
    return np.unique(grams(words, n))
