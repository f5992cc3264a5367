"""Rabin-Karp hashes of every window of a sequence, as array arithmetic modulo 2**64."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    for k, base in enumerate((BASE, _INVERSE)):
        while len(_powers[k]) < n:
            with np.errstate(over="ignore"):
                step = np.uint64(pow(base, len(_powers[k]), 2**64))
                _powers[k] = np.concatenate([_powers[k], _powers[k] * step])
    return _powers[0][:n], _powers[1][:n]


def window_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """One 64-bit hash for each window of ``length`` values (unsigned 64-bit); empty if there is none."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(values))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(0x1234567)) * up, dtype=np.uint64)])
        return mix((sums[length:] - sums[:-length]) * down[:n])
