"""Powers for polynomial hashes of substrings modulo 2^64."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_made: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1, or more, of the base, and of its inverse. With prefix sums S of code times
    power, (S[b] - S[a]) * inverse[a] is the hash of the characters a to b, wherever they are."""
    if not _made or len(_made[0][0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _made[0] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _made[0]
