"""Vectorised rolling hashes over code points and words."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_KNOWN = mix(np.arange(1 << 16, dtype=_U) + _U(1))


def _letters(values: np.ndarray) -> np.ndarray:
    """Random-looking 64-bit value of each symbol; the common ones by table."""
    if values.dtype == np.uint32 and (not len(values) or values.max() < 1 << 16):
        return _KNOWN[values]
    return mix(values.astype(_U) + _U(1))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, _U)
        self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(_BASE))]), dtype=_U)
                self.down = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(pow(_BASE, -1, 1 << 64)))]), dtype=_U)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values; equal runs have equal hashes."""
    n = len(values)
    if n < k:
        return np.empty(0, _U)
    with np.errstate(over="ignore"):
        up, down = POWERS.upto(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(_letters(values) * up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
        h ^= h >> _U(31)
        h *= _U(0x94D049BB133111EB)
        h ^= h >> _U(32)
        return h


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """Sliding minimum or maximum of window ``w`` in linear time (block prefixes and suffixes)."""
    n = len(x)
    fill = x.max() if op is np.minimum else x.min()
    pad = -n % w
    y = np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(-1, w)
    head = op.accumulate(y, axis=1).ravel()[:n]
    tail = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return op(tail[: n - w + 1], head[w - 1 :])


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of hashes that are the least of some window of ``w`` neighbours.

    Two sequences that share ``w`` consecutive hashes select the same one among them.
    """
    n = len(h)
    if n == 0:
        return np.empty(0, np.int64)
    if n <= w:
        return np.flatnonzero(h == h.min())
    least = _sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, h.dtype)
    most = _sliding(np.concatenate([edge, least, edge]), w, np.maximum)
    return np.flatnonzero(h == most)
