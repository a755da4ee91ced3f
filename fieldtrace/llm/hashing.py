"""64-bit hashes of many byte ranges of a block at once, in numpy.

The hash of a range is a polynomial over random numbers per byte value, taken from running sums and
mixed at the end, so its cost does not depend on how the block is cut. Same bytes, same hash, on every
machine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from fieldtrace.llm.common import SPACE_BYTES

U64 = np.uint64
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """`n` fixed random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    found = np.full(size, base, dtype=U64)
    found[0] = 1
    return np.multiply.accumulate(found)


class RangeHash:
    """Hashes of ranges of byte arrays."""

    def __init__(self, seed: int):
        self.values = numbers(seed, 256)
        self.base = int(numbers(seed + 1, 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each range `data[start:end]`; an empty range has a hash of its own."""
        size = 1 << max(16, int(len(data)).bit_length())
        sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(self.values[data] * _powers(self.base, size)[: len(data)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * _powers(self.inverse, size)[starts]
        return mix(found + (ends - starts).astype(U64))


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """The hash of sequences, whose members' hashes stand in arrays of equal length."""
    found = np.full(len(parts[0]), len(parts), dtype=U64)
    for part in parts:
        found = mix(found * U64(0x9E3779B97F4A7C15) + part)
    return found
