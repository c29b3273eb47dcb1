"""Polynomial hashes of all windows of an array, modulo 2^64."""

from __future__ import annotations

import numpy as np

STEP = 0x9E3779B97F4A7C15


def _series(step: int, n: int) -> np.ndarray:
    factors = np.full(n, step, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


class _Powers:
    """Powers of the multiplier and of its inverse, as far as they were needed so far."""

    up = down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << n.bit_length()
            self.up, self.down = _series(STEP, size), _series(pow(STEP, -1, 1 << 64), size)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """Equal windows have equal hashes; the reverse holds by chance only. Prefix sums, shifted back by inverse powers."""
    n = len(values)
    up, down = _powers.of(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return (sums[width:] - sums[:-width]) * down[: n - width + 1]
