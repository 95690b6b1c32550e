"""Vectorised hashes of substrings, and texts as compressed bytes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from .common import slices

_r = np.random.default_rng(400)
_TABLES = [_r.integers(0, 2**64, 256, dtype=np.uint64) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 17), base, np.uint64)
        known[0] = 1
        _powers[base] = known = np.multiply.accumulate(known)
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    h = h ^ (h >> np.uint64(32))
    for _ in range(2):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


class Hashes:
    """Hashes of any substrings of a text: mixed polynomials modulo 2^64 over random byte
    values. ``which`` (0 or 1) chooses one of two independent ones."""

    def __init__(self, x: np.ndarray, which: int):
        base = _BASES[which]
        self.up = _power(base, len(x) + 1)
        self.sum = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_TABLES[which][x] * _power(pow(base, -1, 1 << 64), len(x) + 1)[: len(x)], out=self.sum[1:])

    def windows(self, width: int) -> np.ndarray:
        """Of all substrings of a width, in order."""
        h = self.sum[width:] - self.sum[:-width]
        h *= self.up[: len(h)]
        h += np.uint64(width * 0xFF51AFD7ED558CCD & (1 << 64) - 1)
        return mix(h)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sum[b] - self.sum[a]) * self.up[a] + (b - a).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))


def give_back() -> None:
    """Memory that this process has freed goes back to the machine, not to its heap only:
    workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # of the GNU library only
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def compress(names: list[str]):
    """For mapInArrow: the first column, a text, becomes Zstandard bytes; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for x in slices(batches):
            packed = pa.array([z.compress(t) for t in texts_of(x.column(0))], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *x.columns[1:]], names)

    return run
