"""Hashed word shingles of many texts at once, for Arrow functions.

Words are runs of bytes other than space and \\x09-\\x0D, with A-Z in lower case. A polynomial hash over all
bytes of a batch gives every word's 64-bit hash by one subtraction; shingles are hashed from word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20  # characters hashed together, unless one text is longer
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
STEPS = np.array([0xD6E8FEB86659FD93, 0xA5A5A5A5A5A5A5A7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * CHUNK)
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[starts:ends], all at once."""
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~SPACE[raw]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t or "") > CHUNK:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t or "")
    if group:
        yield group


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles; of fewer words, one for all of them."""
    if not 1 <= width <= len(STEPS):
        raise ValueError(f"width must be 1 to {len(STEPS)}")
    for group in chunks(texts):
        parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in group]
        raw = np.frombuffer(b"\n".join(parts), np.uint8)
        starts, ends = word_spans(raw)
        words = spans(raw, starts, ends)
        edge = np.cumsum([0, *(len(p) + 1 for p in parts)])
        first = np.searchsorted(starts, edge)
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for i in range(width):
            rolled += words[i:i + n] * STEPS[i]
        rolled = mix(rolled)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= width:
                yield np.unique(rolled[a:b - width + 1])
            elif b > a:
                yield mix(np.array([(words[a:b] * STEPS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
