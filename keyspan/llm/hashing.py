"""Hashes of words and of runs of words, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
#: Odd multipliers; any would do.
BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = x + _U(salt)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_codes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. A table of known words would save little time and grow with the corpus."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


class Rolling:
    """Hashes of every n words in a row: sums of codes times powers of an odd base, modulo 2**64."""

    def __init__(self, base: np.uint64) -> None:
        self._base = base
        self._inverse = _U(pow(int(base), -1, 1 << 64))
        self._powers = self._inverses = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            n = max(n, 2 * len(self._powers))
            for name, b in (("_powers", self._base), ("_inverses", self._inverse)):
                x = np.full(n, b, _U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def __call__(self, codes: np.ndarray, n: int) -> np.ndarray:
        if len(codes) < n:
            return np.zeros(0, _U)
        self._grow(len(codes))
        sums = np.zeros(len(codes) + 1, _U)
        np.cumsum(codes * self._inverses[: len(codes)], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * self._powers[: len(codes) - n + 1])


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n values in a row."""
    if len(x) < n:
        return x[:0]
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x
