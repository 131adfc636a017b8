"""Rolling hashes of byte strings, vectorised.

A string's hash is a polynomial over a random table of its bytes, modulo 2^64, from prefix sums; a final
mix makes every bit depend on all of them. ``salt`` gives independent functions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes hashed at one time; longer texts go in overlapping segments.
SEGMENT = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _tables(salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1_000 + salt)
    table = rng.integers(0, 2**64, 256, dtype=np.uint64)
    base = int(rng.integers(0, 2**64, dtype=np.uint64)) | 5
    n = SEGMENT + 4096

    def powers(b: int) -> np.ndarray:
        steps = np.full(n + 1, b, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return table, powers(base), powers(pow(base, -1, 2**64))


class Prefix:
    """Prefix hashes of one segment (at most ``SEGMENT`` + 4,096 bytes)."""

    def __init__(self, data: np.ndarray, salt: int = 0):
        table, power, self.inverse = _tables(salt)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data] * power[: len(data)], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        """The hash of every substring of ``width`` bytes."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``width`` consecutive values, by doubling."""
    span, out = 1, values
    while 2 * span <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[: len(out) - (width - span)], out[width - span:]) if span < width else out
